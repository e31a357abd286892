"""Corpus pipeline over ``documents``.

Language ID (rejected documents go), cross-site line dedup, SimHash
near-dedup (one document of each group stays), harmonic packing. Every stage
works on all its predecessor kept, is written as Parquet and read again. SQL
cannot express the learned first stage, the fingerprints or the tokenizer, so
there is no oracle; ``tests/llm`` holds the stages against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import langid, linededup, packing, simhash
from gaugeworks.llm.common import prepare, staged, table
from gaugeworks.llm.tokens import token_ids


def _held(docs: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """The needed columns and all others as one struct, so no name of an operator meets a user's; and the columns that restore ``docs``."""
    others = [c for c in docs.columns if c not in needed]
    held = docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_gw_rest")) if others else docs
    return held, [F.col(f"_gw_rest.`{c}`") if c in others else F.col(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones (no letter, or under the calibrated threshold) go. Other columns are kept, whatever their names."""
    prepare(spark)
    held, columns = _held(docs, "doc_id", "text", "lang")
    judged = langid.predict(held, langid.fit(held))
    return judged.where(~F.col("rejected")).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, boilerplate lines removed but for their first occurrence; ``n_chars`` is counted anew. Other columns are kept, whatever their names."""
    prepare(spark)
    held, columns = _held(docs, "doc_id", "text", "source", "n_chars")
    out = linededup.remove_boilerplate(held)
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group of texts (3-word shingles, 3 bits), that of smallest id; rows without an id stay.

    Rows that share an id but not a text group are kept each for its group. Other columns are kept, whatever their names.
    """
    prepare(spark)
    held, columns = _held(docs, "doc_id", "text")
    keep = simhash.survivors(held, shingle=3, max_bits=3)
    at = ["doc_id", "text_hash"]
    kept = held.withColumn("text_hash", simhash.text_hash("text")).join(keep, at, "left_semi").dropDuplicates(at).drop("text_hash")
    return kept.unionByName(held.where("doc_id is null")).select(*columns)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a kept document in sequences of at most 4096 tokens, with its ids (unsigned, little-endian, 16-bit)."""
    prepare(spark)
    ids = token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), "word", id_bytes=2)
    return packing.pack(ids, ids_col="ids", id_bytes=2).drop("k", "part", "rank")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("harmonic_packing", harmonic_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
