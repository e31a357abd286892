"""Ranked lexical search with bag deduplication.

A document is first restricted to the vocabulary of the items: what is left of
it is a bag of (term, tf) and its length class ``m``. Documents with the same
bag and the same ``m`` score alike for every item, so they form one class:
the group key is a hash of both and the bytes themselves, which verifies the
hash, and copies are combined before the shuffle. Each class is scored once
against the items that share a term with it; every task keeps its 50 best
classes per item, and the members of the winners are expanded by ascending id.

The 50 best classes of an item, ordered by score and then by their smallest id,
are enough for its 50 best documents: each of them has a member in front of
every member of any later class.

Items are dealt into blocks whose vocabulary fits ``BLOCK_TERMS`` distinct
terms, the bound on what is broadcast (a single item with more terms is a block
of its own); each block reads the documents once. N, L, n, tf and df cover all
documents and whole texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, prepare, staged, text_bytes

TOP = 50
#: Distinct terms of the items of one block, about: what each task holds of them.
BLOCK_TERMS = 400_000
#: Cells of the score matrix that a task holds at once.
SCORE_CELLS = 2_000_000
#: Salt of the first of two rounds that merge the tasks' best classes.
MERGE_SALT = 32
_EXACT = 1 << 53

# Terms are maximal runs of ASCII letters, digits and all bytes above 0x7F (so of all other code points); A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """The items of one block: its vocabulary and, per term, the items that hold it."""

    def __init__(self, items: list[tuple[int, bytes]]):
        """``items``: (number of the item, distinct terms joined by spaces)."""
        self.item_no = np.array([i for i, _ in items], np.int64)
        self.vocab: dict[bytes, int] = {}
        pairs = [(self.vocab.setdefault(t, len(self.vocab)), k) for k, (_, terms) in enumerate(items) for t in terms.split()]
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.posting_items = both[:, 1]
        self.posting_start = np.searchsorted(both[:, 0], np.arange(len(self.vocab) + 1))
        self.most_terms = int(np.bincount(both[:, 1]).max()) if len(both) else 0


def _bags(docs: DataFrame, id_col: str, text_col: str, block) -> DataFrame:
    """``(doc_id, n, bag)`` of the documents with a term; bag = ascending (term number, tf) as unsigned 32-bit pairs."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        vocab = block.value.vocab
        for b in batches:
            keep, sizes, bags = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                count = Counter(words)
                known = sorted((vocab[t], tf) for t, tf in count.items() if t in vocab)
                keep.append(i)
                sizes.append(len(words))
                bags.append(np.array(known, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                                             names=["doc_id", "n", "bag"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_t")).mapInArrow(run, f"doc_id {kind}, n bigint, bag binary")


def _document_counts(classes: DataFrame, block) -> np.ndarray:
    """df of every term of the block (tasks send one array each, combined by Spark; the driver gets one row per term)."""
    def run(batches):
        df = np.zeros(len(block.value.vocab), np.int64)
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(-1, 2)
            sizes = np.array([len(x) >> 3 for x in b.column(0).to_pylist()], np.int64)
            df += np.bincount(flat[:, 0], np.repeat(b.column(1).to_numpy(), sizes), len(df)).astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    rows = classes.select("bag", "members").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(block.value.vocab), np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


def scores_of(bags: list[bytes], m: np.ndarray, block: Block, weights: np.ndarray) -> np.ndarray:
    """Scores of the classes (rows) for the items of the block (columns), as exact integers."""
    flat = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), [len(x) >> 3 for x in bags])
    term, tf = flat[:, 0], flat[:, 1]
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    n = block.posting_start[term + 1] - block.posting_start[term]
    ends = np.cumsum(n)
    item = block.posting_items[np.repeat(block.posting_start[term] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    cell, value = np.repeat(row, n) * len(block.item_no) + item, np.repeat(gain, n)
    cells = len(bags) * len(block.item_no)
    if block.most_terms * int(weights.max(initial=0)) * 1_000_000 < _EXACT:  # sums are whole doubles
        return np.bincount(cell, value, cells).astype(np.int64).reshape(len(bags), -1)
    out = np.zeros(cells, np.int64)
    np.add.at(out, cell, value)
    return out.reshape(len(bags), -1)


def _best(score: np.ndarray, first: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best positive scores, ties by ``first``."""
    at = np.flatnonzero(score > 0)
    if len(at) > top:
        edge = np.partition(score[at], len(at) - top)[len(at) - top]
        at = at[score[at] >= edge]
    return at[np.lexsort((first[at], -score[at]))][:top]


def _task_winners(classes: DataFrame, block, weights, top: int) -> DataFrame:
    """The best classes per item of each task: ``(item_no, class, score, first)``."""
    def run(batches):
        blk, w = block.value, weights.value
        n_items = len(blk.item_no)
        held = [(np.zeros(0, np.int64),) * 3 for _ in range(n_items)]
        floor = np.ones(n_items, np.int64)  # least score that can still enter
        for b in batches:
            step = max(1, SCORE_CELLS // max(n_items, 1))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                s = scores_of(part.column(1).to_pylist(), part.column(2).to_numpy(), blk, w)
                cls, first = part.column(0).to_numpy(), part.column(3).to_numpy()
                for k in np.flatnonzero(s.max(axis=0, initial=0) >= floor).tolist():
                    at = _best(s[:, k], first, top)
                    old = held[k]
                    new = tuple(np.concatenate([o, x[at]]) for o, x in zip(old, (cls, s[:, k], first)))
                    pick = _best(new[1], new[2], top)
                    held[k] = tuple(x[pick] for x in new)
                    floor[k] = held[k][1][-1] if len(pick) == top else 1
        sizes = [len(h[0]) for h in held]
        cls, score, first = (np.concatenate([h[j] for h in held] or [np.zeros(0, np.int64)]) for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(blk.item_no, sizes)), pa.array(cls), pa.array(score), pa.array(first)],
                                         names=["item_no", "class", "score", "first"])

    return classes.select("class", "bag", "m", "first").mapInArrow(run, "item_no bigint, class bigint, score bigint, first bigint")


def _top(df: DataFrame, keys: list[str], order: list, top: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, id_col: str, text_col: str, items: list[tuple[int, bytes]], top: int) -> DataFrame:
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast(Block(items))
    bags = staged(_bags(docs, id_col, text_col, block), "lexical-bags")
    total = bags.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    m = F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {n_terms}L)")
    known = bags.where(F.length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("bag", "m"))
    # nulls have no place in an order of ids: they come last
    last = F.lit((1 << 63) - 1)
    classes = known.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("class"), "h", "m", "bag", F.coalesce(F.col("first").cast("bigint"), last).alias("first"),
                                    "members"), "lexical-classes")
    df = _document_counts(classes, block)
    weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], np.int64))
    won = _task_winners(classes, block, weights, top).withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(MERGE_SALT)))
    order = [F.desc("score"), F.asc("first")]
    won = staged(_top(_top(won, ["item_no", "salt"], order, top), ["item_no"], order, top).select("item_no", "class", "score"), "lexical-winners")
    chosen = classes.join(won.select("class").distinct(), "class", "left_semi")
    chosen = staged(chosen.select("class", "h", F.col("m").alias("_m"), F.col("bag").alias("_bag")), "lexical-chosen")
    if (chosen.agg(F.sum(F.length("_bag") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    members = known.join(chosen, "h").where((F.col("m") == F.col("_m")) & (F.col("bag") == F.col("_bag"))).select("class", "doc_id")
    members = _top(members, ["class"], [F.asc_nulls_last("doc_id")], top).select("class", "doc_id")
    found = won.join(staged(members, "lexical-members"), "class")
    return _top(found, ["item_no"], [F.desc("score"), F.asc_nulls_last("doc_id")], top).select("item_no", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """``(item_id, rank int, doc_id, score long)``: the ``top`` best documents of every item with a score above 0.

    Null or empty texts and texts without a term have no terms: such documents
    are not counted in N, such items have no result. Repeated document rows
    are documents each; repeated item rows are answered each. Null document ids come
    last among equal scores; a null item id stays null. Very long texts are
    read whole. Empty tables give an empty result; extra columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    item_kind = dict(items.dtypes)[item_col]

    def distinct_terms(batches):
        for b in batches:
            words = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([b" ".join(w) for w in words], pa.binary())],
                                             names=["item_id", "n", "terms"])

    told = items.select(F.col(item_col).alias("item_id"), text_bytes(item_text).alias("_t")) \
        .mapInArrow(distinct_terms, f"item_id {item_kind}, n bigint, terms binary").where("n > 0")
    told = staged(told.withColumn("item_no", F.monotonically_increasing_id()), "lexical-items")
    blocks = max(1, -(-(told.agg(F.sum("n")).first()[0] or 0) // BLOCK_TERMS))
    found = None
    for k in range(blocks):
        rows = told.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == k).select("item_no", "terms").collect()
        part = _search_block(docs, id_col, text_col, [(r[0], bytes(r[1])) for r in rows], top)
        found = part if found is None else found.unionByName(part)
    return found.join(told.select("item_no", "item_id"), "item_no").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"),
                                                                           F.col("doc_id").alias(id_col), "score")
