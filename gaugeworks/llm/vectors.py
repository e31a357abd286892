"""Embedding near-duplicates: random-hyperplane tables, exact cosine, components.

Equal vectors are first merged into classes (smallest id, number of rows), so a
vector in a third of all rows is one point. Each class vector is signed by
random hyperplanes, so many bits a table that a bucket holds about ``BUCKET_FILL`` unrelated vectors
whatever the size of the table, and goes to one bucket per table. At cosine 0.95
two vectors agree in a bit with probability 0.899; there are so many tables that a pair at the threshold
shares a bucket with probability ``RECALL`` (closer pairs with more): 13 tables of
10 bits for 50 000 vectors, 59 of 23 for 400 million. Inside a bucket all pairs are verified by their cosine in double
precision, as blocks of a matrix product. A pair that shares several buckets
counts in the first one only, which both signatures tell without a shuffle, so
a task returns per vector its number of new links and a spanning forest, never
the pairs. Buckets beyond ``BUCKET_ROWS`` are dealt as pairs of chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, spread, staged
from .components import components
from .disjoint import union

THRESHOLD = 0.95
RECALL = 0.995
BUCKET_FILL = 64
BITS = (8, 30)
SEED = 20_011
#: Buckets beyond this many class vectors are split into pairs of chunks (a task size, not a cap).
BUCKET_ROWS = 2_048
GROUP_ROWS = 16_000
_BLOCK = 512


def layout(classes: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket and number of tables for so many distinct vectors."""
    bits = int(min(max(np.ceil(np.log2(max(classes, 1) / BUCKET_FILL)), BITS[0]), BITS[1]))
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - RECALL) / np.log1p(-together))) if together < 1 else 1


def _planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, count))


def sign(vectors: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their bucket number in each table."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    side = (unit @ _planes(vectors.shape[1], tables * bits) > 0).reshape(len(unit), tables, bits)
    return unit, side @ (1 << np.arange(bits))


def _signed(classes: DataFrame, kind: str, bits: int, tables: int) -> DataFrame:
    def run(batches):
        for b in batches:
            lists = b.column("_v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, start = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                unit, sig = sign(flat[start[rows][:, None] + np.arange(dim)], bits, tables)
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").take(pick), b.column("mult").take(pick), pa.array(np.full(len(rows), dim, np.int32)),
                     pa.array([u.tobytes() for u in unit], pa.binary()),
                     pa.array([s.astype("<i4").tobytes() for s in sig], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * tables, pa.array(sig.ravel().astype(np.int32)))],
                    names=["rep", "mult", "dim", "unit", "sig", "buckets"])

    return classes.select("rep", "mult", "_v").mapInArrow(
        run, f"rep {kind}, mult bigint, dim int, unit binary, sig binary, buckets array<int>")


def _links_of_group(table: pa.Table, threshold: float) -> pa.Table:
    """Per entry of the group its new links (rows) and, off its set's first entry, that entry."""
    n = table.num_rows
    col = {c: table.column(c).to_numpy() for c in ("mult", "dim", "turn", "bucket", "lo", "hi", "own")}
    rep = table.column("rep").combine_chunks()
    task = np.lexsort((col["own"], col["hi"], col["lo"], col["dim"], col["bucket"], col["turn"]))
    keys = np.stack([col[c][task] for c in ("turn", "bucket", "dim", "lo", "hi")])
    cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
    unit, sig = table.column("unit").to_pylist(), table.column("sig").to_pylist()
    count, label = np.zeros(n, np.int64), np.arange(n)
    for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if end - at < 2:
            continue
        rows = task[at:end]
        turn = int(col["turn"][rows[0]])
        u = np.frombuffer(b"".join([unit[i] for i in rows]), "<f8").reshape(len(rows), -1)
        s = np.frombuffer(b"".join([sig[i] for i in rows]), "<i4").reshape(len(rows), -1)[:, :turn]
        first = int(np.searchsorted(col["own"][rows], col["hi"][rows[0]]))  # rows of the second chunk start here
        alone = col["lo"][rows[0]] == col["hi"][rows[0]]
        for r in range(0, len(rows) if alone else first, _BLOCK):
            stop = min(r + _BLOCK, len(rows) if alone else first)
            right = r if alone else first
            i, j = np.nonzero(u[r:stop] @ u[right:].T >= threshold)
            i, j = i + r, j + right
            if alone:
                up = i < j
                i, j = i[up], j[up]
            new = ~(s[i] == s[j]).any(axis=1)
            i, j = rows[i[new]], rows[j[new]]
            if len(i):
                count += np.bincount(i, col["mult"][j], n).astype(np.int64) + np.bincount(j, col["mult"][i], n).astype(np.int64)
                label = union(label, i, j)
    told = np.flatnonzero((count > 0) | (label != np.arange(n)))
    return pa.table({"node": rep.take(pa.array(told)), "other": rep.take(pa.array(label[told])), "links": pa.array(count[told])})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, n_links long, component_id, kept)`` for every row of ``vectors``.

    Null, empty or zero vectors and those with null or non-finite components
    link with nothing and are their own component; vectors link only with
    vectors of the same length. Rows with a null id still count as linked rows,
    but neither name nor join components (their component is that of their
    vector's class, if any). Repeated rows are rows: each counts the others.
    An empty table gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    usable = F.expr(f"`{vector_col}` is not null and size(`{vector_col}`) > 0 and exists(`{vector_col}`, x -> x <> 0) and "
                    f"not exists(`{vector_col}`, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, F.col(vector_col).cast("array<double>")).alias("_v"))
    kind = dict(vectors.dtypes)[id_col]
    classes = rows.where("_v is not null").groupBy("_v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = staged(classes, "vector-classes")
    total = classes.count()
    bits, tables = layout(total, threshold)
    signed = staged(_signed(classes, kind, bits, tables), "vector-signs")
    spots = signed.select("*", F.posexplode("buckets").alias("turn", "bucket")).drop("buckets")
    crowded = spots.groupBy("turn", "bucket", "dim").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS) \
        .select("turn", "bucket", "dim", F.expr(f"cast(ceil(n / {BUCKET_ROWS}) as int)").alias("chunks"))
    crowded = broadcast_if_small(staged(crowded, "vector-crowded"), 24)
    placed = spots.join(crowded, ["turn", "bucket", "dim"], "left") \
        .withColumn("own", F.expr("cast(pmod(xxhash64(unit), coalesce(chunks, 1)) as int)")) \
        .withColumn("with", F.explode(F.expr("sequence(0, coalesce(chunks, 1) - 1)"))) \
        .withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with"))
    tasks = placed.select("rep", "mult", "dim", "unit", "sig", "turn", "bucket", "own", "lo", "hi")
    groups = spread(total * tables, GROUP_ROWS, spark)
    told = tasks.withColumn("_g", F.pmod(F.xxhash64("turn", "bucket", "dim", "lo", "hi"), F.lit(groups))) \
        .groupBy("_g").applyInArrow(lambda t: _links_of_group(t, threshold), f"node {kind}, other {kind}, links bigint")
    told = staged(told, "vector-links")
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(told.where("node <> other").select("node", "other"), "node", "other").withColumnRenamed("node", "member")
    named = classes.join(links, classes["rep"].eqNullSafe(links["node"]), "left") \
        .join(comp, F.col("rep") == F.col("member"), "left") \
        .select("_v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, "_v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
