"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hardneg, html, langid, lexical, linededup, oracles, packing, phrases, pieces, simhash, tokenfile, urls, vectors, warc
from .common import table
from .tokens import token_ids


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines removed from all documents."""
    out = linededup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_removed")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    ids = token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word")
    pieces = packing.cut_pieces(ids, ids_col="ids").withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.place_pieces(packing.staged(pieces, "pack"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back by verified boundary chains."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of all documents."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to SentencePiece ids and decoded again."""
    docs = table(spark, sf_dir, "documents")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files and read back."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("part")


#: (verdict, host and path) of the registered URL filter.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL judged by rules and, where none fits, by character models."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector against all vectors."""
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hardneg.mine(table(spark, sf_dir, "embeddings"), label, anchor=F.expr("coalesce(vec_id % 100 = 0, false)"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    out = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_harmonic_packing, op3_warc_archive, op4_html_main_text, op5_embedding_near_dedup, op6_simhash_near_dedup,
    op7_sentencepiece, op8_phrase_fingerprints, op9_language_id, op10_token_files, op11_url_filter, op12_hard_negatives, op13_lexical_search)}

ORACLE = {
    "op11_url_filter": oracles.URL_FILTER,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_lexical_search": oracles.LEXICAL,
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, pos, raw, trim(raw, ' ') AS line
            FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
                         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
        spread AS (
            SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> ''
            GROUP BY line HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
        marked AS (
            SELECT l.*, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
            FROM lines l LEFT JOIN spread s ON l.line = s.line),
        cleaned AS (
            SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
                   CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
               coalesce(c.n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id""",
}
