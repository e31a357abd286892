"""SimHash near-duplicates: fingerprints and a binary-trie self-join.

Fingerprints: words of the ASCII-lower-cased text are its runs of bytes other
than space and 0x09-0x0D; shingles of ``shingle`` words joined by one space
(repeats count; fewer words: the whole sequence; none: fingerprint 0) are
hashed with XXH64 (seed 42); a bit is 1 if set in over half the hashes.

Join: two 64-bit values within ``max_bits`` < 4 differing bits agree in one of
four 16-bit blocks. Each distinct fingerprint is stored once per block, rotated
so that this block leads, and the block is its shard. Inside a shard a binary
trie (four levels a step) is joined with itself: node pairs go down together
and add up differing bits, and a pair beyond the budget is pruned with all
below it. A shard with more than ``SHARD_ROWS`` fingerprints is split by its
next bits into node-pair tasks that start from the pairs within budget, so
no shard is one task's work. A task reports a spanning forest of the links it
found, never the pairs; components join the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, staged, text_bytes
from .components import components
from .disjoint import union

#: Shards beyond this many fingerprints are split by trie node pairs (a task size, not a cap).
SHARD_ROWS = 20_000
#: Node pairs expanded at once in a task (bounds its memory).
STEP_PAIRS = 2_000_000
_CHUNK = 1 << 15
_POP4 = np.array([bin(i).count("1") for i in range(16)], np.int8)


def simhash64(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    lo, hi = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(lo), _CHUNK):
        h = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(lo[i:i + _CHUNK], hi[i:i + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(lo), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, fp long)`` per row; the 64 bits are those of the unsigned fingerprint."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash64(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), text_bytes(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _steps(total: np.ndarray) -> list[tuple[int, int]]:
    """Cut a run of pairs into pieces whose expansions stay under STEP_PAIRS."""
    done = np.cumsum(total)
    cuts, lo = [], 0
    while lo < len(total):
        base = done[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(done, base + STEP_PAIRS, "right")))
        cuts.append((lo, hi))
        lo = hi
    return cuts


def trie_forest(root: np.ndarray, key: np.ndarray, pairs: np.ndarray, max_bits: int, bits: int = 48) -> np.ndarray:
    """Labels of the entries after linking all within ``max_bits`` bits.

    ``root`` and ``key`` (unsigned, ``bits`` low bits in use) are sorted by
    (root, key) without repeats; ``pairs`` holds the pairs of root values to join
    (equal values: a trie with itself).
    """
    n = len(key)
    label = np.arange(n)
    if n == 0:
        return label
    levels = []  # per level: node of each entry
    for shift in range(bits, -1, -4):
        part = key >> np.uint64(shift) if shift < 64 else np.zeros(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = (root[1:] != root[:-1]) | (part[1:] != part[:-1])
        levels.append(np.cumsum(new) - 1)
    first, count, digit = [], [], []
    for d in range(len(levels) - 1):
        up, down = levels[d], levels[d + 1]
        start = np.flatnonzero(np.diff(down, prepend=-1))  # first entry of each child
        parent = up[start]
        first.append(np.searchsorted(parent, np.arange(up[-1] + 1)))
        count.append(np.bincount(parent, minlength=up[-1] + 1))
        digit.append(((key[start] >> np.uint64(bits - 4 * (d + 1))) & np.uint64(15)).astype(np.int8))
    top = np.unique(root)
    pairs = pairs[np.isin(pairs, top).all(axis=1)]
    node = levels[0][np.searchsorted(root, pairs)]  # root value -> node number
    stack = [(0, node[:, 0], node[:, 1], np.zeros(len(node), np.int8))]
    while stack:
        d, u, v, diff = stack.pop()
        if d == len(levels) - 1:
            apart = u != v
            label = union(label, u[apart], v[apart])
            continue
        total = count[d][u] * count[d][v]
        cuts = _steps(total)
        if len(cuts) > 1:
            stack.extend((d, u[a:b], v[a:b], diff[a:b]) for a, b in cuts)
            continue
        i = np.repeat(np.arange(len(u)), total)
        off = np.arange(len(i)) - np.repeat(np.cumsum(total) - total, total)
        width = count[d][v][i]
        x, y = first[d][u][i] + off // width, first[d][v][i] + off % width
        spent = diff[i] + _POP4[digit[d][x] ^ digit[d][y]]
        keep = (spent <= max_bits) & ((u != v)[i] | (x <= y))
        if keep.any():
            stack.append((d + 1, x[keep], y[keep], spent[keep]))
    return label


def trie_links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``(src, dst)`` of a forest per shard over ``classes(fp long, rep)``, one row per distinct fp."""
    if not 0 <= max_bits <= 3:
        raise ValueError("four blocks find up to 3 differing bits")
    spark = classes.sparkSession
    turned = classes.select("rep", "fp", F.explode(F.array(*[F.lit(16 * t) for t in range(4)])).alias("turn")).select(
        "rep", "turn", F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn) * cast(turn > 0 as bigint)").alias("key")
    ).withColumn("block", F.expr("cast(shiftrightunsigned(key, 48) as int)"))
    hot = turned.groupBy("turn", "block").agg(F.count("*").alias("rows")).where(F.col("rows") > SHARD_ROWS) \
        .select("turn", "block", F.expr(f"least(8, cast(ceil(log2(rows / {SHARD_ROWS})) as int) + 1)").alias("deep"))
    placed = turned.join(hot, ["turn", "block"], "left")
    own = F.expr("cast(shiftrightunsigned(key, 48 - deep) & (shiftleft(1L, deep) - 1) as int)")
    whole = placed.where("deep is null").select("rep", "key", "turn", "block", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("own"))
    split = placed.where("deep is not null").withColumn("own", own).withColumn(
        "other", F.explode(F.expr(f"filter(sequence(0, cast(shiftleft(1, deep) - 1 as int)), y -> bit_count(y ^ own) <= {max_bits})"))
    ).select("rep", "key", "turn", "block", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    tasks = whole.unionByName(split)
    groups = spread(4 * classes.count(), SHARD_ROWS, spark)
    rep_kind = dict(classes.dtypes)["rep"]

    def join_group(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("key", "turn", "block", "lo", "hi", "own")}
        key = cols["key"].view(np.uint64) & np.uint64((1 << 48) - 1)
        task = np.stack([cols["turn"].astype(np.int64) << 16 | cols["block"], cols["lo"].astype(np.int64) << 8 | cols["hi"]], axis=1)
        _, task_no = np.unique(task[:, 0] << 16 | task[:, 1], return_inverse=True)
        # two roots in a split task (own = lo and own = hi), one otherwise
        root = task_no.astype(np.int64) * 2 + (cols["own"] != cols["lo"])
        order = np.lexsort((key, root))
        root, key = root[order], key[order]
        tasks = np.unique(task_no)
        same = np.zeros(len(tasks), bool)
        same[task_no] = cols["lo"] == cols["hi"]
        pairs = np.stack([tasks * 2, tasks * 2 + ~same], axis=1)
        label = trie_forest(root, key, pairs, max_bits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        rep = table.column("rep").combine_chunks().take(pa.array(order))
        return pa.table({"src": rep.take(pa.array(moved)), "dst": rep.take(pa.array(label[moved]))})

    return tasks.withColumn("_g", F.pmod(F.xxhash64("turn", "block", "lo", "hi"), F.lit(groups))) \
        .groupBy("_g").applyInArrow(lambda t: join_group(t), f"src {rep_kind}, dst {rep_kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """``(id_col, fp long, component)`` per row of ``docs``.

    ``component`` is the smallest id reachable over links of at most ``max_bits``
    differing bits, the row's own id included. Null or empty texts have
    fingerprint 0 and are linked like any other; rows whose id is null take the
    component of their fingerprint (null if no other row has it); an empty table
    gives an empty result; extra columns are ignored.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    classes = fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep"))
    classes = staged(classes, "simhash-classes")
    # rows that share an id link their fingerprints' representatives through that id
    again = fps.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("fp").alias("f0"), F.max("fp").alias("f1"), F.collect_set("fp").alias("fs")) \
        .where("f0 <> f1").select(F.col(id_col).alias("dst"), F.explode("fs").alias("fp"))
    same_id = again.join(classes, "fp").select(F.col("rep").alias("src"), "dst")
    links = trie_links(classes, max_bits).unionByName(same_id)
    comp = components(links, "src", "dst")
    where = classes.join(comp, classes["rep"] == comp["node"], "left") \
        .select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(where, "fp", "left").select(id_col, "fp", "component")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id_col, text_hash)`` of one row per text group: the smallest id, then the smallest ``text_hash(text_col)``.

    A text group is a component of fingerprints linked by at most ``max_bits``
    differing bits. Shared ids link nothing, so rows of one id with unrelated
    texts are judged each in its own group. Rows without an id are left out.
    """
    at = docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col), text_hash(text_col).alias("text_hash")).alias("at"), text_col)
    fps = fingerprints(at, "at", text_col, shingle)
    classes = staged(fps.groupBy("fp").agg(F.min("at").alias("first")), "simhash-classes")
    comp = components(trie_links(classes.select("fp", F.col("fp").alias("rep")), max_bits), "src", "dst")
    return classes.join(comp, classes["fp"] == comp["node"], "left").groupBy(F.coalesce("component", "fp").alias("group")) \
        .agg(F.min("first").alias("first")).select("first.*")


def text_hash(text_col: str):
    return F.xxhash64(text_bytes(text_col))
