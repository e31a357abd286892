"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols (code points). Each round merges runs of equal
symbols, then labels every symbol by deterministic coin tossing: the lowest bit
in which it differs from its left neighbour and that bit's value. Four rounds
of this bring 64-bit symbols to labels 0..5 with equal neighbours nowhere, so
local maxima are at most a few symbols apart. They start the phrases; a phrase's
name is a hash of its symbols, and the names are the next round's sequence.
Whether a place is a phrase start depends on a few symbols around it only, so
equal substrings are parsed alike inside, wherever they stand.

A fingerprint is the bottom sketch of the names from level ``LEVEL`` up (and the
root's): the ``KEEP`` smallest 32-bit hashes in rising order, in hex. Its
likeness to another is the share of phrases they have in common, 2J / (1 + J)
for the Jaccard estimate J; sets that fit into the sketch are compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 2
KEEP = 64
#: Code points parsed at once in a task (a single longer text is parsed alone).
BATCH_CHARS = 1 << 19
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _toss(label: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One round of coin tossing; ``head`` marks the first symbol of each document."""
    left = np.empty_like(label)
    left[1:], left[:1] = label[:-1], 0
    differ = label ^ left
    differ[head] = _ONE
    place = np.bitwise_count((differ & (~differ + _ONE)) - _ONE).astype(np.uint64)
    return place << _ONE | (label >> place & _ONE)


def _phrase_starts(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    label = symbols
    for _ in range(4):
        label = _toss(label, head)
    label = label.astype(np.int8)
    peak = np.zeros(len(label), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[1:][head[1:]] = False
    peak[:-1][head[1:]] = False  # the last symbol of a document has no right neighbour
    return peak | head


def phrase_names(texts: list[str]) -> list[np.ndarray]:
    """Distinct 32-bit phrase names per text (level LEVEL and up, and the root), rising."""
    size = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), size)
    names, owners, level = [], [], 0
    while len(symbols):
        level += 1
        head = np.ones(len(doc), bool)
        head[1:] = doc[1:] != doc[:-1]
        # runs of one symbol become one symbol that knows their length
        first = head.copy()
        first[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(first)
        if len(at) < len(symbols):
            run = np.diff(at, append=len(symbols)).astype(np.uint64)
            symbols, doc, head = symbols[at], doc[at], head[at]
            long = run > _ONE
            symbols[long] = _mix(symbols[long] + run[long] * np.uint64(0xA24BAED4963EE407))
        start = np.flatnonzero(_phrase_starts(symbols, head))
        length = np.diff(start, append=len(symbols))
        inside = (np.arange(len(symbols)) - np.repeat(start, length)).astype(np.uint64)
        mixed = _mix(symbols + inside * np.uint64(0x9FB21C651E98DF25))
        symbols = _mix(np.add.reduceat(mixed, start) + length.astype(np.uint64))
        doc = doc[start]
        left = np.bincount(doc, minlength=len(texts))
        done = left[doc] == 1  # the root of its document
        told = np.ones(len(doc), bool) if level >= LEVEL else done
        names.append((symbols[told] >> np.uint64(32)).astype(np.int64))
        owners.append(doc[told])
        symbols, doc = symbols[~done], doc[~done]
    if not names:
        return [np.zeros(0, np.int64) for _ in texts]
    key = np.unique(np.concatenate(owners) << 32 | np.concatenate(names))
    cut = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
    return [key[a:min(b, a + KEEP)] & 0xFFFFFFFF for a, b in zip(cut[:-1], cut[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of phrases in common, 0 to 1; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    top = min(int(x[-1]) if len(x) == KEEP else 1 << 32 for x in (a, b))
    x, y = {i for i in a.tolist() if i <= top}, {i for i in b.tolist() if i <= top}
    both, all_of = len(x & y), len(x | y)
    return 2 * both / (all_of + both) if all_of else 0.0


def render(names: np.ndarray) -> str:
    return names.astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of ``following``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(rows: list[tuple], last: tuple | None) -> tuple[list[tuple], tuple]:
    """Results of the rows that have a follower in ``rows``; ``last`` is the row carried over with its names."""
    texts = [r[1] for r in rows]
    edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
    fresh = phrase_names((texts if last is None else texts[1:]) + edited)
    own = fresh[:len(texts)] if last is None else [last, *fresh[:len(texts) - 1]]
    changed = fresh[len(fresh) - len(edited):]
    out = []
    for i, (row, text) in enumerate(zip(rows, edited)):
        out.append((row[0], len(row[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), render(own[i]), render(changed[i]),
                    likeness(own[i], changed[i]), likeness(own[i], own[i + 1])))
    return out, own[-1]


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(part, ghost, id, text)``: documents in ranges of their ids, each range with its follower as a ghost.

    Range starts are ids that occur, so the first document of a range is known
    without a look at it; it is sent to the range before as well, and the very
    first document to the last range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = rows.agg(F.min("id"), F.count("*"), F.count("id"), F.percentile_approx("id", [i / parts for i in range(1, parts)], F.lit(20 * parts))).first()
    bounds = np.unique(np.array(facts[3] or [], np.int64))
    lowest, has_null = facts[0], facts[1] != facts[2]
    last_part = len(bounds)

    @F.pandas_udf("array<int>")
    def route(ids, nulls):
        import pandas as pd

        out = []
        for i, null in zip(ids, nulls):
            here = 0 if null else int(np.searchsorted(bounds, i, "right"))
            to = [here]
            if not null and here and bounds[here - 1] == i:
                to.append(-here)  # ghost in part here - 1
            if null if has_null else i == lowest:
                to.append(-(last_part + 1))
            out.append(to)
        return pd.Series(out)

    routed = rows.withColumn("to", F.explode(route(F.coalesce("id", F.lit(0)), F.col("id").isNull())))
    return routed.select(F.when(F.col("to") < 0, -F.col("to") - 1).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("ghost"), "id", "text") \
        .repartition(parts, "part").sortWithinPartitions("part", "ghost", F.col("id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (:func:`edit` with the next document).

    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null text is empty; an empty text has the empty
    fingerprint, alike to another empty one only. Documents follow in the order
    of id (null first), then text; the first follows the last; a single document
    follows itself. Repeated rows are kept. Extra columns are ignored.
    """

    def run(batches):
        held, names, part, chars = [], None, None, 0

        def told(rows):
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[
                id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for p, ghost, i, t in zip(*(b.column(c).to_pylist() for c in ("part", "ghost", "id", "text"))):
                if p != part:
                    held, names, part, chars, closed = [], None, p, 0, False
                if closed:
                    continue  # a ghost has been met: further ghosts repeat its id
                held.append((i, t))
                chars += len(t)
                closed = ghost
                if ghost or chars >= BATCH_CHARS or len(held) >= 512:
                    if len(held) > 1:
                        rows, names = _compare(held, names)
                        yield told(rows)
                        held, chars = held[-1:], 0

    return _neighbours(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
