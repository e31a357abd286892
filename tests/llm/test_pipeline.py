"""The corpus pipeline stage by stage against plain versions, and the registered queries."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from gaugeworks.llm import linededup, queries
from gaugeworks.llm.common import prepare, staged
from gaugeworks.llm.tokens import ChunkEncoder
from test_text_operators import check_packing, plain_components, plain_line_dedup, plain_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, starting from documents with odd rows among them."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(100_001, "12 34 -- 5", "en", "src1", 10), (100_002, None, "en", "src1", None), (100_003, "", None, None, 0),
           (None, "The of and in the that is to a and the of in for that", "en", "src2", 53)]
    twice = docs.where("doc_id = 3")
    out = {"documents": staged(docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(twice), "t")}
    at = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        at = out[name] = staged(stage(spark, at, SF), "t")
    return out


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_only_unreadable_documents_are_rejected(kept):
    before, after = kept["documents"], kept["language_id"]
    gone = {r[0] for r in rows(before, "doc_id")} - {r[0] for r in rows(after, "doc_id")}
    assert gone == {100_001, 100_002, 100_003} and after.columns == before.columns
    assert after.where("doc_id = 3").count() == 2


def test_line_dedup_stage(kept):
    before = rows(kept["language_id"], "doc_id", "text", "source")
    after = rows(kept["line_dedup"], "doc_id", "text", "n_chars")
    want = [(i, t) for i, t, _ in plain_line_dedup(before, linededup.MIN_SITES)]
    assert sorted(((i, t) for i, t, _ in after), key=str) == sorted(want, key=str)
    assert all(n == len(t) for _, t, n in after)


def test_near_dedup_stage_keeps_one_of_each_group(kept):
    before = dict(rows(kept["line_dedup"].where("doc_id is not null"), "doc_id", "text"))
    ids = list(before)
    comp = plain_components(ids, [plain_simhash(before[i]) for i in ids], 3)
    after = rows(kept["simhash_near_dedup"], "doc_id")
    assert sorted(i for i, in after if i is not None) == sorted(set(comp.values())) and (None,) in after
    assert kept["simhash_near_dedup"].columns == kept["documents"].columns


def test_near_dedup_stage_keeps_a_row_of_each_text_group_when_ids_clash(spark):
    """Two rows share id 1 with unrelated texts, each has a copy of another id; id 7 repeats one text."""
    prepare(spark)
    x, y, z = ("".join(f"{w}{i} " for i in range(60)) for w in ("red", "blue", "green"))
    rows_ = [(1, x), (1, y), (2, x), (3, y), (7, z), (7, z), (8, z), (None, z), (9, None), (9, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows_], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = rows(corpus_pipeline.simhash_near_dedup(spark, docs, SF), "doc_id", "text")
    assert sorted(((i, t or "") for i, t in got), key=str) == sorted([(1, x), (1, y), (7, z), (None, z), (9, "")], key=str)


def test_packing_stage_holds_every_token(kept):
    enc = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), "word", 2)
    whole = {i: enc.encode(t or "") + np.array([2], "<u2").tobytes() for i, t in rows(kept["simhash_near_dedup"], "doc_id", "text")}
    pieces = kept["harmonic_packing"]
    check_packing(rows(pieces, "doc_id", "start", "length", "sequence_id", "offset"), {i: len(x) // 2 for i, x in whole.items()})
    for i, start, length, ids in rows(pieces, "doc_id", "start", "length", "ids"):
        assert bytes(ids) == whole[i][2 * start:2 * (start + length)]


CLASHES = ["score", "lang_pred", "rejected", "n_removed", "text_hash", "_gw_row", "_lang", "_gone", "fp", "component", "_h", "Text_Hash2"]


def test_stages_keep_columns_whose_names_they_use_themselves(spark):
    """Columns named like an operator's own come through every filtering stage as they are, in their places."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [docs]
    extra = docs.select(*[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES[:6]], "*",
                        *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES[6:]])
    at = staged(extra, "t")
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = staged(stage(spark, at, SF), "t")
        assert at.columns == extra.columns
        plain.append(staged(stage(spark, plain[-1], SF), "t"))
        assert rows(at, *docs.columns) and sorted(rows(at, *docs.columns), key=str) == sorted(rows(plain[-1], *docs.columns), key=str)
    for c in CLASHES:
        assert at.where(F.col(c) != F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string"))).count() == 0, c
    packed = corpus_pipeline.STAGES[3][1](spark, at, SF)
    assert packed.count() > 0


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(rows(got, *cols), key=str) == sorted(want.fetchall(), key=str), name


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "harmonic_packing"]


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.countDistinct("doc_id")).first()[0] > 100
