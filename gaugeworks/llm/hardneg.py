"""Hard-negative mining with an inverted multi-index.

Vectors are cut into two halves; each half has its own codebook (k-means on a
bounded sample, ``SAMPLE_ROWS``), and the two nearest codewords name the
vector's cell. All rows are indexed. The index is dealt into shards of about
``SHARD_ROWS`` rows by a hash of the row, so copies of one vector or a large
label spread over shards; anchors are dealt into blocks of ``ANCHOR_ROWS``. Every
(shard, block) is one task: a stated query set against all rows, in blocks.

Inside a task an anchor scores both codebooks by upper bounds (inner product
with the codeword plus anchor norm times the radius of the codeword's members,
by Cauchy-Schwarz), and a multi-sequence heap visits the cells in order of the
summed bounds of their halves. A search stops when no cell left can change it:
the best positives are certified once the next bound is under the fifth score, a
window of negatives once the next bound is under its tenth score or its lower
edge. So the codebooks decide the speed only: results are exact.

The first pass gives each shard's best positives, merged to the global ones; these
set the windows of the second pass, whose certified candidates are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged

#: Rows the codebooks are learned from, about (chosen by a hash threshold); all rows are indexed.
SAMPLE_ROWS = 4_096
#: Rows that a cell of a shard should hold; a half has the square root of so many cells as codewords.
CELL_ROWS = 64
#: Rows of a shard, about; while there are fewer shards than tasks, they may shrink to the lesser number.
SHARD_ROWS = 65_536
LEAST_SHARD_ROWS = 2_048
ANCHOR_ROWS = 16_384
SEED = 90_021
_EXACT = 1 << 53
_LONG = (-(1 << 63), (1 << 63) - 1)
# what is added to a bound for the rounding of its doubles, relative to its size
_SLACK = 1e-9


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes * codes).sum(axis=1) - 2 * (x @ codes.T), axis=1)


def codebook(x: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """``size`` codewords at most, by k-means from distinct sampled points."""
    points = np.unique(x, axis=0) if x.shape[1] else x[:1]
    if len(points) <= size:
        return points
    codes = points[np.random.default_rng(SEED).choice(len(points), size, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, codes)
        n = np.bincount(near, minlength=size)
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    return codes


def _products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at its ends."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(rows.shape[1], 1)
    if most < _EXACT:
        return (rows @ anchor).astype(np.int64)
    a = [int(v) for v in anchor.tolist()]
    return np.array([min(max(sum(int(v) * w for v, w in zip(r, a)), _LONG[0]), _LONG[1]) for r in rows.tolist()], np.int64)


class Cells:
    """The inverted multi-index of one shard: its rows by cell, with the radius of each codeword's members."""

    def __init__(self, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = vectors.shape[1] // 2
        self.half = half
        self.sides = []
        names = []
        for x, codes in zip((vectors[:, :half], vectors[:, half:]), books):
            near = _nearest(x, codes)
            used, near = np.unique(near, return_inverse=True)
            codes = codes[used]
            far = np.sqrt(((x - codes[near]) ** 2).sum(axis=1))
            radius = np.zeros(len(used))
            np.maximum.at(radius, near, far)
            self.sides.append((codes, radius))
            names.append(near)
        cell = names[0] * len(self.sides[1][0]) + names[1]
        self.order = np.argsort(cell, kind="stable")
        found, starts = np.unique(cell[self.order], return_index=True)
        self.span = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])))
        self.vectors = vectors[self.order]

    def bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """Upper bound of the half score per codeword of each half."""
        out = []
        for a, (codes, radius) in zip((anchor[:self.half], anchor[self.half:]), self.sides):
            length = np.sqrt(a @ a)
            at = codes @ a + length * radius
            out.append(at + _SLACK * (np.abs(codes) @ np.abs(a) + length * radius + 1))
        return out

    def visit(self, anchor: np.ndarray):
        """``(bound of all cells left before this one, first row, end row)`` of the cells with rows, best bound first."""
        left, right = self.bounds(anchor)
        lo, ro = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
        ls, rs = left[lo].tolist(), right[ro].tolist()
        lo, ro, wide = lo.tolist(), ro.tolist(), len(right)
        heap = [(-(ls[0] + rs[0]), 0, 0)]
        while heap:
            top, i, j = heapq.heappop(heap)
            if j + 1 < wide:
                heapq.heappush(heap, (-(ls[i] + rs[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(lo):  # each pair is entered once: along its row, from the row's first
                heapq.heappush(heap, (-(ls[i + 1] + rs[0]), i + 1, 0))
            span = self.span.get(lo[i] * wide + ro[j])
            if span is not None:
                yield -top, *span


def _first(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ident[at], -score[at]))][:k]


class Shard:
    """Rows of a task by vector length, searched by certified windows."""

    #: Rows scored at once.
    BATCH = 1_024

    def __init__(self, row, ident, label, vectors, books):
        self.cells = Cells(vectors, books)
        o = self.cells.order
        self.row, self.ident, self.label = row[o], ident[o], label[o]

    def _score(self, anchor, spans):
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        return at, _products(self.cells.vectors[at], anchor)

    def _batches(self, anchor, done):
        """Scored rows in batches of cells until ``done(bound of what is left)``."""
        spans, held = [], 0
        for bound, a, b in self.cells.visit(anchor):
            if held >= self.BATCH:
                yield self._score(anchor, spans)
                spans, held = [], 0
            if not spans and done(bound):
                return
            spans.append((a, b))
            held += b - a
        if spans:
            yield self._score(anchor, spans)

    def positives(self, anchor, row: int, label: int, k: int):
        """The ``k`` best other rows of the label: (id, score, row)."""
        score, ident, rows = (np.zeros(0, np.int64) for _ in range(3))
        for at, s in self._batches(anchor, lambda bound: len(score) == k and bound < score[-1]):
            pick = (self.label[at] == label) & (self.row[at] != row)
            score, ident, rows = (np.concatenate(x) for x in ((score, s[pick]), (ident, self.ident[at[pick]]), (rows, self.row[at[pick]])))
            best = _first(score, ident, k)
            score, ident, rows = score[best], ident[best], rows[best]
        return ident, score, rows

    def negatives(self, anchor, label: int, positive: list[int], low: int, high: int, k: int):
        """Per positive score the ``k`` best rows of other labels inside its window: lists of (id, score)."""
        lows, highs = [low * p for p in positive], [high * p for p in positive]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in positive]
        open_ = [n for n in range(len(positive)) if lows[n] <= highs[n]]

        def done(bound):
            open_[:] = [n for n in open_ if not (100 * bound < lows[n] or len(held[n][0]) == k and bound < held[n][0][-1])]
            return not open_

        for at, s in self._batches(anchor, done):
            other = self.label[at] != label
            at, s = at[other], s[other]
            for n in open_:
                # -(-a // b): the least whole score of the window
                pick = (s >= -(-lows[n] // 100)) & (s <= highs[n] // 100)
                if pick.any():
                    score, ident = np.concatenate((held[n][0], s[pick])), np.concatenate((held[n][1], self.ident[at[pick]]))
                    best = _first(score, ident, k)
                    held[n] = score[best], ident[best]
        return held


_NO_ID = (1 << 63) - 1  # in the place of a null id: last among equal scores


def _shards(t: pa.Table, books: dict):
    """Anchors and the index of each vector length of a group."""
    dim, side = t.column("dim").to_numpy(), t.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
    row, label = t.column("row").to_numpy(), t.column("label").to_numpy()
    ident = t.column("id").fill_null(_NO_ID).to_numpy()
    raw = t.column("vec").to_pylist()
    for d in np.unique(dim).tolist():
        rows, asked = np.flatnonzero((dim == d) & ~side), np.flatnonzero((dim == d) & side)
        if len(rows) and len(asked):
            x = np.frombuffer(b"".join([raw[i] for i in rows]), "<f8").reshape(len(rows), d)
            book = books.get(d, (np.zeros((1, d // 2)), np.zeros((1, d - d // 2))))
            shard = Shard(row[rows], ident[rows], label[rows], x, book)
            for i in asked.tolist():
                yield i, np.frombuffer(raw[i], "<f8"), int(row[i]), int(label[i]), shard


def _dealt(index: DataFrame, anchors: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Index rows by (shard, block) and anchors beside them, in groups."""
    own = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    rows = index.select("*", F.lit(False).alias("anchor"), F.lit(None).cast("array<bigint>").alias("scores"), own,
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = anchors.select("row", "id", "label", "dim", "vec", F.lit(True).alias("anchor"), "scores",
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"),
                           F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    return rows.unionByName(asked).groupBy("shard", "block")


def mine(vectors: DataFrame, label, id_col: str = "vec_id", vector_col: str = "embedding", anchor=None, scale: int = 256,
         n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score)`` of every anchor and positive.

    ``label`` is the column of labels (integers), ``anchor`` the condition of anchors (all rows,
    if none). Rows with a null label, a null vector or null or non-finite
    components take no part. Vectors meet vectors of their own length only;
    an empty vector scores 0. Rows with a null id are candidates, last among equal
    scores. Repeated rows are rows: a copy of an anchor is another row, and a copy of
    an anchor row is an anchor. An anchor without a positive or a positive without
    a negative in its window gives no row. Scores beyond 64 bits stop at
    its ends. An empty table gives an empty result; extra columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    fit = F.expr(f"`{vector_col}` is not null and not exists(`{vector_col}`, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"), (F.lit(True) if anchor is None else anchor).alias("asked"), fit.alias("fit")) \
        .where("label is not null and fit").drop("fit").withColumn("row", F.monotonically_increasing_id())

    def scaled(batches):
        for b in batches:
            lists = b.column("v")
            ends = lists.offsets.to_numpy()
            flat = np.floor(lists.values.to_numpy(zero_copy_only=False) * float(scale)).astype("<f8")
            vec = [flat[a:e].tobytes() for a, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("label"), pa.array(np.diff(ends).astype(np.int32)),
                                              pa.array(vec, pa.binary()), b.column("asked")], names=["row", "id", "label", "dim", "vec", "asked"])

    index = staged(rows.mapInArrow(scaled, "row bigint, id bigint, label bigint, dim int, vec binary, asked boolean"), "hard-index")
    total = index.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = index.where(F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "vec").collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // SHARD_ROWS), min(tasks, -(-total // LEAST_SHARD_ROWS)))
    size = max(2, round((total / shards / CELL_ROWS) ** 0.5))
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    books = {}
    for d, raw in by_dim.items():
        x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), d)
        books[d] = (codebook(x[:, :d // 2], size), codebook(x[:, d // 2:], size))
    shared = spark.sparkContext.broadcast(books)
    anchors = index.where("asked")
    blocks = max(1, -(-anchors.count() // ANCHOR_ROWS))

    def positives(t: pa.Table) -> pa.Table:
        out = []
        for i, a, row, lab, shard in _shards(t, shared.value):
            ident, score, rows = shard.positives(a, row, lab, n_positives)
            out += [(row, *x) for x in zip(rows.tolist(), ident.tolist(), score.tolist())]
        return _table(out, ("a_row", "p_row", "p_id", "p_score"))

    index, kept = index.select("row", "id", "label", "dim", "vec"), anchors.select("row", "id", "label", "dim", "vec")
    near = _dealt(index, kept.withColumn("scores", F.lit(None).cast("array<bigint>")), shards, blocks) \
        .applyInArrow(positives, "a_row bigint, p_row bigint, p_id bigint, p_score bigint")
    order = Window.partitionBy("a_row").orderBy(F.desc("p_score"), "p_id", "p_row")
    near = staged(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n_positives), "hard-positives")
    windows = near.groupBy("a_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p_score"))), lambda x: x["p_score"]).alias("scores"))

    def negatives(t: pa.Table) -> pa.Table:
        wanted, out = t.column("scores").to_pylist(), []
        for i, a, row, lab, shard in _shards(t, shared.value):
            for n, (score, ident) in enumerate(shard.negatives(a, lab, wanted[i], low, high, n_negatives), 1):
                out += [(row, n, *x) for x in zip(ident.tolist(), score.tolist())]
        return _table(out, ("a_row", "n", "n_id", "n_score"))

    asked = kept.join(windows, kept["row"] == windows["a_row"]).drop("a_row")
    far = _dealt(index, asked, shards, blocks).applyInArrow(negatives, "a_row bigint, n bigint, n_id bigint, n_score bigint")
    order = Window.partitionBy("a_row", "n").orderBy(F.desc("n_score"), "n_id")
    far = staged(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives), "hard-negatives")
    found = far.join(near, ["a_row", "n"]).join(kept.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id")), "a_row")

    def named(col: str):
        return F.when(F.col(col) != _NO_ID, F.col(col))

    return found.select("anchor_id", named("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("n_id").alias("negative_id"),
                        F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})
