"""Line dedup, packing, SimHash, language ID, token files, fingerprints and pieces against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import langid, linededup, packing, phrases, pieces, simhash, tokenfile
from gaugeworks.llm.common import prepare, staged
from gaugeworks.llm.tokens import ChunkEncoder, token_ids

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, n bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, repeated rows, ties, and extra columns whose names operators use inside."""
    prepare(spark)
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, "Hello big wide world\n\nsame line\nHello big wide world", "en", "a"), (2, None, "en", "b"), (3, "", "de", None),
            (4, long, "en", "c"), (4, long, "en", "c"), (5, "  \t\n ", None, "a"), (None, "same line\nno id here", "fr", "d"),
            (6, "ünïcödé ﬁ ①   wide　space \x1c end", "fr", "e"), (7, "hello BIG wide world", "en", "f"), (8, "x" * 5000, "en", "g")]
    return spark.createDataFrame([(*r, None, 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def empty(df):
    return df.where("false")


# ---------------------------------------------------------------- tokens and packing

@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunks_encode_like_whole_texts(name, kind):
    enc = ChunkEncoder(public_tokenizers.path(name), kind)
    rng = random.Random(3)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "9", "!", "é", "é", "́", "Σ", "<|endoftext|>", "中", "😀"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc._tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100, 1365, 1366, 2048, 2049, 3000, 4095, 4096, 4097, 12_345])
def test_cut_covers_a_document(n):
    at = 0
    for start, length, k in packing.cut(n):
        assert start == at and 0 < length <= 4096 // k
        at += length
    assert at == n


def check_packing(rows, lengths):
    """rows: doc, start, length, sequence, offset; every token once, sequences gapless and bounded."""
    by_doc, by_seq = {}, {}
    for doc, start, length, seq, offset in rows:
        by_doc.setdefault(doc, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
    assert {d for d, n in lengths.items() if n} == set(by_doc)
    for doc, got in by_doc.items():
        at = 0
        for start, length in sorted(got):
            assert start == at
            at += length
        assert at == lengths[doc]
    padding = 0
    for got in by_seq.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing_places_every_token_once(spark):
    rng = random.Random(5)
    lengths = {i: int(rng.lognormvariate(6, 1.3)) for i in range(3000)}
    df = spark.createDataFrame(list(lengths.items()), "doc_id bigint, n_ids bigint").repartition(7)
    rows = rows_of(packing.pack(df), "doc_id", "start", "length", "sequence_id", "offset")
    assert check_packing(rows, lengths) < 0.02 * sum(lengths.values())


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 0, 0), (None, 5000, 0), (3, 10, 0)], "doc_id bigint, n_ids bigint, k int")
    rows = rows_of(packing.pack(df), "doc_id", "start", "length", "sequence_id", "offset")
    check_packing(rows, {None: 5000, 3: 10})
    assert packing.pack(empty(df)).count() == 0


def test_packed_ids_are_the_document(odd):
    ids = token_ids(odd.where("doc_id in (1, 6, 8)"), public_tokenizers.path("word_bpe_49k.json"), "word")
    whole = {r["doc_id"]: bytes(r["ids"]) for r in ids.collect()}
    got = {}
    for r in packing.pack(ids, ids_col="ids").orderBy("doc_id", "start").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert got == whole


def test_token_file_round_trip(spark, odd):
    enc = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    out = rows_of(tokenfile.round_trip(odd, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start"), "doc_id", "start", "n_tokens", "ids_crc32")
    at, want = 0, []
    for doc_id, text in sorted(rows_of(odd, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = enc.encode(text or "") + np.array([2], "<u4").tobytes()
        want.append((doc_id, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert out == want
    assert tokenfile.round_trip(empty(odd), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_block_codes_every_width():
    values = np.array([0, 1, 255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    raw = tokenfile.encode_block(3, [7, None, 9], [values, values[:0], values[::-1]]) + b"\n"
    raw += tokenfile.encode_block(3, [10], [values[:0]]) + b"\n"
    (part, _, numbers, lengths, got), (_, _, more, _, none) = tokenfile.decode_file(raw)
    assert (part, numbers, lengths.tolist(), more, len(none)) == (3, [7, None, 9], [9, 0, 9], [10], 0)
    assert got.tolist() == values.tolist() + values[::-1].tolist()
    with pytest.raises(ValueError):
        list(tokenfile.decode_file(raw[:-1] + b"x"))


# ---------------------------------------------------------------- line dedup

def plain_line_dedup(rows, min_sites):
    sites, first = {}, {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r in rows:
        for pos, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            line = line.strip(" ")
            if line:
                sites.setdefault(line, set()).add(r[2])
                spot = (*key(r), pos)
                first[line] = min(first.get(line, spot), spot)
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0))
            continue
        kept, gone = [], 0
        for pos, raw in enumerate(r[1].split("\n")):
            line = raw.strip(" ")
            if line and len(sites[line] - {None}) >= min_sites and first[line] != (*key(r), pos):
                gone += 1
            else:
                kept.append(raw)
        out.append((r[0], "\n".join(kept), gone))
    return sorted(out, key=str)


def test_line_dedup_matches_plain(spark, odd, docs):
    sample = odd.select("doc_id", "text", "source").unionByName(docs.select("doc_id", "text", "source").where("doc_id > 10"))
    rows = rows_of(sample, "doc_id", "text", "source")
    for limit in (2, 3):
        got = sorted(rows_of(linededup.remove_boilerplate(sample, min_sites=limit), "doc_id", "text", "n_removed"), key=str)
        assert got == plain_line_dedup(rows, limit)
        assert any(g[2] for g in got)


def test_line_dedup_counts_near_the_threshold_exactly(spark):
    """Lines on 395 to 405 sites around a threshold of 400: sketches are off by a few there."""
    rows = [(i * 1000 + s, f"line number {i}", f"site{s}") for i in range(395, 406) for s in range(i)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = rows_of(linededup.remove_boilerplate(df, min_sites=400).groupBy(F.expr("doc_id div 1000")).agg(F.sum("n_removed").alias("n")), "*")
    assert dict(got) == {i: (i - 1 if i >= 400 else 0) for i in range(395, 406)}


def test_line_dedup_keeps_columns_and_empty_tables(odd):
    out = linededup.remove_boilerplate(odd)
    assert out.columns == [*odd.columns, "n_removed"] and out.count() == odd.count()
    assert linededup.remove_boilerplate(empty(odd)).count() == 0


# ---------------------------------------------------------------- SimHash

def plain_simhash(text, k=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_plain(docs, odd):
    for df in (docs, odd.select("doc_id", "text")):
        want = sorted((r[0] if r[0] is not None else -1, plain_simhash(r[1])) for r in rows_of(df, "doc_id", "text"))
        got = sorted((r[0] if r[0] is not None else -1, r[1] % (1 << 64)) for r in rows_of(simhash.fingerprints(df), "doc_id", "fp"))
        assert got == want


def plain_components(ids, fps, bits):
    rep = {i: i for i in ids}

    def find(x):
        while rep[x] != x:
            x = rep[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(ids[a]), find(ids[b])
                rep[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_trie_join_finds_all_links(spark, monkeypatch, shard_rows):
    """Random and clustered fingerprints, with whole shards and with shards split by node pairs."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "STEP_PAIRS", 500)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for center in list(fps)[:12]:
        for _ in range(30):
            x = center
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps, key=lambda _: rng.random())
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in zip(fps, ids)], "fp bigint, rep bigint")
    from gaugeworks.llm.components import components

    got = {i: i for i in ids} | dict(rows_of(components(simhash.trie_links(df), "src", "dst"), "node", "component"))
    assert got == plain_components(ids, fps, 3)


def test_near_duplicates_of_documents(docs, odd):
    known = rows_of(docs, "doc_id", "text")
    got = dict((r[0], r[2]) for r in rows_of(simhash.near_duplicates(docs), "doc_id", "fp", "component"))
    assert got == plain_components([r[0] for r in known], [plain_simhash(r[1]) for r in known], 3)
    out = rows_of(simhash.near_duplicates(odd), "doc_id", "component")
    assert len(out) == odd.count() and (2, 2) in out and (3, 2) in out and (5, 2) in out and out.count((4, 4)) == 2 and (7, 7) in out
    assert simhash.near_duplicates(empty(odd)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    from gaugeworks.llm.components import components

    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 300)] + [(5, 5), (7, None), (59, 3)]
    got = dict(rows_of(components(spark.createDataFrame(chain, "a int, b int"), "a", "b"), "node", "component"))
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 300)}


# ---------------------------------------------------------------- language ID

def test_language_id_on_held_out_documents(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.fit(docs)).where(langid.held_out()).select("lang", "lang_pred", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out) > 100
    assert sum(r["rejected"] for r in out) <= 0.01 * len(out)


def test_language_id_rejects_what_it_cannot_know(spark, odd, docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[2]["score"] == 0.0 and got[2]["rejected"]
    assert all(r["lang_pred"] in [*model.languages, "und"] and 0 <= r["score"] <= 1 for r in got.values())
    foreign = spark.createDataFrame([(1, "Где находится библиотека, скажите пожалуйста"), (2, "12 34 ++")], "doc_id bigint, text string")
    assert [r["rejected"] for r in langid.predict(foreign, model).orderBy("doc_id").collect()] == [True, True]


def test_language_id_never_learns_held_out_or_unlabelled_rows(spark, docs):
    lied = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in langid.fit(lied).languages
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.languages == [] and langid.predict(docs, none).select("lang_pred").distinct().collect()[0][0] == "und"


# ---------------------------------------------------------------- fingerprints by phrases

def test_equal_substrings_share_interior_phrases():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(4000))
    shared, a, b = word(), word(), word()
    one, two, alone = phrases.phrase_names([a + shared, b[:1777] + shared + b, shared])
    assert phrases.likeness(one, two) > 0.2 and phrases.likeness(one, alone) > 0.45
    again = phrases.phrase_names([shared])[0]
    assert again.tolist() == alone.tolist() and phrases.likeness(again, alone) == 1.0


def test_phrases_do_not_depend_on_the_batch():
    texts = ["", "a", "aaaa", "ab" * 50, "the quick brown fox", "x" * 1000 + "y", "é" * 3, "".join(map(chr, range(40, 400)))]
    together = phrases.phrase_names(texts)
    assert [t.tolist() for t in together] == [phrases.phrase_names([t])[0].tolist() for t in texts]
    assert len({phrases.render(t) for t in together}) == len(texts)
    assert phrases.likeness(together[0], together[0]) == 1.0 and phrases.likeness(together[0], together[1]) == 0.0


def test_fingerprints_follow_the_next_document(spark, docs, odd):
    for df in (docs.repartition(5), odd.select("doc_id", "text").where("doc_id is null or doc_id <> 4")):
        known = sorted(rows_of(df.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        got = {r["doc_id"]: r for r in phrases.fingerprints(df).collect()}
        assert len(got) == len(known)
        for (i, text), (_, after) in zip(known, known[1:] + known[:1]):
            edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
            assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, e, n = phrases.phrase_names([text, edited, after])
            assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (phrases.render(a), phrases.render(e))
            assert got[i]["near_edited"] == phrases.likeness(a, e) and got[i]["near_next"] == phrases.likeness(a, n)
    assert phrases.fingerprints(odd).count() == odd.count()
    assert phrases.fingerprints(empty(odd)).count() == 0
    one = phrases.fingerprints(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# ---------------------------------------------------------------- pieces

def test_pieces_equal_the_library(spark, docs, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.vocabulary(path).model
    for df in (docs.limit(40), odd.select("doc_id", "text").where("doc_id is not null")):
        texts = {(r[0], r[1]) for r in rows_of(df, "doc_id", "text")}
        got = pieces.encode(df, path).collect()
        assert len(got) == df.count()
        for r in got:
            text = next(t for i, t in texts if i == r["doc_id"]) or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == model.encode(text)
            assert r["decoded"] == model.decode(model.encode(text)) == text
    assert pieces.encode(empty(odd), path).count() == 0


def test_long_units_merge_like_the_library():
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    for n in (63, 200, 3000):
        unit = "▁" + "".join(rng.choice(["th", "e", "in", "anti", "qu", "é", "Ω", "z"]) for _ in range(n))
        ids = np.frombuffer(v.unit_ids(unit, None), "<u4").tolist()
        assert len(unit) > pieces.UNIT_CHARS and ids == v.model.encode(unit[1:])


def test_units_of_a_column_are_those_of_the_plain_pattern():
    import pyarrow as pa

    letters = "A-Za-zÀ-ÖØ-öø-ɏ"
    plain = re.compile(f" *[{letters}]+| *[^ {letters}]+| +")
    rng = random.Random(2)
    alphabet = [*"aZ[@`{1\n\x00×÷ÀÖØöøÿĀȿɀɏɐʰé¿\u0301中😀▁", " ", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(3000)] + [f"a{chr(c)}b-{chr(c)}-" for c in range(0x80, 0x400)]
    column, ends = pieces.units(pa.array(["cut off", *texts]).slice(1))
    found = column.to_pylist()
    assert len(ends) == len(texts) + 1 and ends[0] == 0 and ends[-1] == len(found)
    for text, a, b in zip(texts, ends, ends[1:]):
        assert found[a:b] == (plain.findall(" " + text.replace("▁", " ")) if text else []), repr(text)
    assert pieces.units(pa.array(["", ""]))[1].tolist() == [0, 0, 0] and pieces.units(pa.array([], pa.string()))[1].tolist() == [0]


def test_codes_of_a_column_of_units_are_those_of_each_unit(monkeypatch):
    """With cuts for some units only, characters outside the vocabulary, long units, and more units than are unfolded at once."""
    import pyarrow as pa

    monkeypatch.setattr(pieces, "MASK_ROWS", 100)
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    units = sorted({rng.choice(["▁", "▁▁", ""]) + "".join(rng.choices(["th", "e", "in", "qu", "é", "Ω", "中", "😀", "\x00"], k=rng.choice([1, 2, 5, 9, 40, 90]))) for _ in range(700)})
    assert min(map(len, units)) == 1 and max(map(len, units)) > pieces.UNIT_CHARS
    known = {u: sum(1 << i for i in np.cumsum([0, *map(len, v.merged(u))]).tolist()) for u in units[::2] if len(u) <= pieces.UNIT_CHARS}
    got = v.codes(pa.array(units), pa.array(list(known)), pa.array(list(known.values()), pa.int64())).to_pylist()
    assert got == [v.unit_ids(u, known.get(u)) for u in units]
    assert v.codes(pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())).to_pylist() == []
    assert all(np.frombuffer(x, "<u4").tolist() == v.model.encode(u[1:]) for u, x in zip(units, got) if u in known and u[0] == "▁" != u[1])


def test_decoded_columns_lose_one_space_and_mark_broken_bytes():
    import pyarrow as pa

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", "a", "  two  spaces ", "中😀", "x"]
    ids = [*map(v.model.encode, texts), [v.byte_id[0xE4], v.byte_id[0xB8]], [v.byte_id[0x41]]]
    for rows, want in ((ids[:5], texts), (ids, [*texts, "\ufffd", "A"])):
        column = pa.array([b"", *(np.array(x, "<u4").tobytes() for x in rows)], pa.binary())
        assert v.decode(column).to_pylist() == ["", *want] and v.decode(column.slice(1)).to_pylist() == want


def test_texts_travel_in_small_compressed_blobs():
    import pyarrow as pa

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 400, 4000]))) for _ in range(150)] + ["x" * (pieces.BLOB_BYTES + 1), "", "é"]
    ids = [None if i % 9 == 0 else i for i in range(len(texts))]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i:i + 64], pa.int64()), pa.array(texts[i:i + 64])], names=["id", "text"]) for i in range(0, len(texts), 64)]
    out = [(n, x) for b in pieces.pack(iter(batches)) for n, x in zip(b.column("no").to_pylist(), b.column("blob").to_pylist())]
    assert [n for n, _ in out] == list(range(len(out))) and len(out) > 5
    tables = [pieces.unpack(x) for _, x in out]
    assert [r for t in tables for r in zip(t["id"].to_pylist(), t["text"].to_pylist())] == list(zip(ids, texts))
    assert all(t.num_rows == 1 or sum(len(x.encode()) for x in t["text"].to_pylist()) <= pieces.BLOB_BYTES for t in tables)
    assert sum(len(x) for _, x in out) < sum(map(len, texts)) / 2


def test_merge_fold_takes_the_best_then_the_leftmost_edge(spark):
    """Against the heap, with equal scores, fractions and pieces of worse score inside better ones."""
    rng = random.Random(6)
    v = object.__new__(pieces.Vocabulary)
    v.score = {p: rng.choice([-0.5, -1.0, -1.25, -2.0, -7.0]) for p in ["".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)]}
    words = {"".join(rng.choice("abc") for _ in range(rng.choice([2, 3, 5, 8, 13, 30, 62]))) for _ in range(200)}
    df = spark.createDataFrame([(w,) for w in words], "unit string")
    table = pieces.piece_table(spark, v.score)
    assert "rank" in table.columns
    got = dict(rows_of(pieces.unit_cuts(df, table, 5, prefixes=pieces.prefix_table(spark, v.score, 2)), "unit", "cuts"))
    assert len(got) > 150
    for w, cuts in got.items():
        at = [i for i in range(len(w) + 1) if cuts >> i & 1]
        assert [w[a:b] for a, b in zip(at, at[1:])] == v.merged(w)


def test_viterbi_fold_is_the_best_path(spark):
    rng = random.Random(4)
    scores = {p: -rng.random() * 5 for p in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} - {"c"}}
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 30, 62)]
    words = [w for w in words if any(p in w for p in scores)]
    df = spark.createDataFrame([(w,) for w in set(words)], "unit string")
    got = dict(rows_of(pieces.unit_cuts(df, pieces.piece_table(spark, scores), 4, "viterbi", -100.0), "unit", "cuts"))

    def cost(parts):
        return sum(scores.get(p, -100.0) if p in scores else (-100.0 if len(p) == 1 else -1e9) for p in parts)

    def segments(w, cuts):
        at = [i for i in range(len(w) + 1) if cuts >> i & 1]
        return [w[a:b] for a, b in zip(at, at[1:])]

    for w in set(words):
        best = [0.0] + [-1e18] * len(w)
        for e in range(1, len(w) + 1):
            best[e] = max(best[s] + cost([w[s:e]]) for s in range(max(0, e - 4), e))
        assert abs(cost(segments(w, got[w])) - best[-1]) < 1e-9


def test_staged_tables_keep_rows(spark, odd):
    assert staged(odd, "test").count() == odd.count()
