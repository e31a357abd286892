"""Harmonic packing of documents into fixed-length sequences.

A document is cut into full sequences first. The rest ``r`` goes to harmonic
class ``k = capacity // r``, whose bins hold exactly ``k`` pieces of at most
``capacity // k`` tokens. A rest that would leave more than ``SLACK`` of its
slot empty gives a piece of exactly ``capacity // (k + 1)`` to class ``k + 1``
(no slack but rounding) and the rule goes on with what is left; rests below
``capacity / FINE`` are not cut further, as their slack is under 1 / FINE.

Since every bin of a class takes the same number of pieces, workers fill bins
without talking: a piece's place is its number in its class, which is the
number within its partition plus the count of earlier partitions. Only the
last, incomplete bin of each class is left over: fewer than ``k`` pieces per
class, a bound that depends on the capacity alone. Those few are placed first
fit, longest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import broadcast_if_small, staged

CAPACITY = 4096
SLACK = 0.01
FINE = 64


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Pieces ``(start, length, class)`` of a document of ``n`` tokens."""
    pieces = [(s, capacity, 1) for s in range(0, n - capacity + 1, capacity)]
    start = len(pieces) * capacity
    while start < n:
        r = n - start
        k = capacity // r
        slot = capacity // k
        if r * FINE <= capacity or slot - r <= SLACK * slot:
            pieces.append((start, r, k))
            break
        length = capacity // (k + 1)
        pieces.append((start, length, k + 1))
        start += length
    return pieces


def cut_pieces(docs: DataFrame, length_col: str = "n_ids", capacity: int = CAPACITY, ids_col: str | None = None,
               id_col: str = "doc_id", id_bytes: int = 4) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, class ``k``, ``part`` and ``rank`` in (part, k).

    With ``ids_col`` (binary, ``id_bytes`` an id) each piece also carries its ids.
    Rows whose length is null or 0 have no piece.
    """
    id_kind = dict(docs.dtypes)[id_col]
    keep = [F.col(id_col).alias("id"), F.col(length_col).cast("bigint").alias("n")] + ([F.col(ids_col).alias("ids")] if ids_col else [])

    def run(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            ns = b.column(1).to_pylist()
            row, start, length, cls, rank, ids = [], [], [], [], [], []
            texts = b.column(2).to_pylist() if ids_col else None
            for i, n in enumerate(ns):
                for s, m, k in cut(n or 0, capacity):
                    row.append(i)
                    start.append(s)
                    length.append(m)
                    cls.append(k)
                    rank.append(seen.get(k, 0))
                    seen[k] = rank[-1] + 1
                    if ids_col:
                        ids.append(texts[i][id_bytes * s:id_bytes * (s + m)])
            pick = pa.array(row, pa.int64())
            cols = [b.column(0).take(pick), pa.array(start, pa.int64()), pa.array(length, pa.int64()), b.column(1).take(pick),
                    pa.array(cls, pa.int32()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = [id_col, "start", "length", "doc_tokens", "k", "part", "rank"]
            if ids_col:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {id_kind}, start bigint, length bigint, doc_tokens bigint, k int, part int, rank bigint"
    return docs.select(*keep).mapInArrow(run, schema + (", ids binary" if ids_col else ""))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces of :func:`cut_pieces`.

    ``pieces`` must be read from a written table, so that part and rank stay.
    """
    counts = pieces.groupBy("k", "part").agg(F.count("*").alias("here"))
    by_class = counts.groupBy("k").agg(F.sum("here").alias("in_class"))
    by_class = by_class.withColumn("bins", F.expr("in_class div k"))
    # at most one row per class: the number of classes depends on the capacity alone
    classes = by_class.withColumn("first_bin", F.sum("bins").over(
        Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    classes = classes.select("k", "bins", F.coalesce("first_bin", F.lit(0)).alias("first_bin"))
    before = counts.withColumn("before", F.coalesce(F.sum("here").over(
        Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = staged(before.join(classes, "k").select("k", "part", "before", "bins", "first_bin"), "pack-places")
    # a row per class and partition: pieces are shuffled for it only if that is too many to send to every executor
    placed = pieces.join(broadcast_if_small(place, 48), ["k", "part"]).withColumn("number", F.col("before") + F.col("rank"))
    full = placed.where("number < bins * k")
    full = full.withColumn("sequence_id", F.expr("first_bin + number div k"))
    inside = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    single = full.where("k = 1").withColumn("offset", F.lit(0).cast("bigint"))
    shared = full.where("k > 1").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    out = [*pieces.columns, "sequence_id", "offset"]
    rest = placed.where("number >= bins * k")
    filled = classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("bins")).scalar()
    # the left-over pieces: fewer than k per class, whatever the size of the input
    first_fit = _first_fit(rest.select(*pieces.columns), capacity)
    first_fit = first_fit.withColumn("sequence_id", F.col("sequence_id") + filled)
    return single.select(*out).unionByName(shared.select(*out)).unionByName(first_fit.select(*out))


def _first_fit(rest: DataFrame, capacity: int) -> DataFrame:
    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(t: pa.Table) -> pa.Table:
        length = t.column("length").to_numpy()
        used = np.zeros(len(length), np.int64)
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.lexsort((t.column("rank").to_numpy(), t.column("part").to_numpy(), -length))
        bins = 0
        for i in order:
            fit = np.flatnonzero(used[:bins] + length[i] <= capacity)
            b = int(fit[0]) if len(fit) else bins
            bins = max(bins, b + 1)
            seq[i], offset[i] = b, used[b]
            used[b] += length[i]
        return t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return rest.groupBy(F.expr("k - k").alias("_all")).applyInArrow(lambda t: fill(t), schema)


def pack(docs: DataFrame, length_col: str = "n_ids", ids_col: str | None = None, id_col: str = "doc_id",
         capacity: int = CAPACITY, id_bytes: int = 4) -> DataFrame:
    """Pack documents given by their token counts (and ids, if ``ids_col`` names them).

    Returns per piece: id, start, length, doc_tokens, sequence_id, offset (gapless
    from 0 in a sequence), ids if given, and k, part, rank. Every token of every
    document is in exactly one piece. Documents without tokens have no row, an
    empty table gives no rows, repeated rows are packed once each, a null id is
    kept as it is, and extra columns are ignored.
    """
    return place_pieces(staged(cut_pieces(docs, length_col, capacity, ids_col, id_col, id_bytes), "pack"), capacity)
