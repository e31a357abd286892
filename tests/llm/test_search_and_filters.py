"""URL filter, hard-negative mining and ranked search against plain versions and their SQL."""

import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from gaugeworks.llm import hardneg, lexical, queries, urls
from gaugeworks.llm.common import prepare

SF = "/root/testdata/sf0.001"
RULES = queries.URL_RULES


def key(row):
    return tuple(map(str, row))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives", "op13_lexical_search"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert rows(got, *got.columns) == sorted(want.fetchall(), key=key)


# ---------------------------------------------------------------- ranked search

def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_search(docs, items, top=50):
    """(item, rank, doc, score) for lists of (id, text)."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m))
                        for t in set(plain_terms(text)) if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=key)


@pytest.fixture(scope="module")
def corpus(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "GAMMA", "naïve", "日本語", "x1", "under_score", "É", "the", "of"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(120)]
    docs += [(200 + i, "the alpha, the beta. (copy)") for i in range(70)]  # more copies than places
    docs += [(300, None), (301, ""), (302, "-- !!"), (None, "alpha beta"), (None, "alpha beta"), (303, "alpha beta"), (303, "alpha beta"),
             (304, "İI ẞ alphá"), (305, "long " * 200_000 + "gamma")]
    items = [(1, "Alpha beta unseen"), (2, None), (3, ""), (4, "the the THE of"), (4, "gamma É"), (None, "x1 日本語"), (5, "zzz"), (6, "under score")]
    return docs, items


def frames(spark, docs, items):
    clash = "h int, class int, first int, score int, rank int, salt int, item_no int"
    more = (0,) * 7
    return (spark.createDataFrame([(*d, *more) for d in docs], f"doc_id bigint, text string, {clash}"),
            spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int"))


def test_search_equals_the_plain_version(spark, corpus):
    docs, items = corpus
    got = rows(lexical.search(*frames(spark, docs, items)), "item_id", "rank", "doc_id", "score")
    assert got == plain_search(docs, items)
    assert sum(r[0] == 1 for r in got) == 50


def test_search_in_several_blocks_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4)
    monkeypatch.setattr(lexical, "SCORE_CELLS", 7)
    monkeypatch.setattr(lexical, "_EXACT", 0)  # the integer path
    assert rows(lexical.search(*frames(spark, docs, items)), "item_id", "rank", "doc_id", "score") == plain_search(docs, items)


def test_search_of_empty_tables(spark, corpus):
    docs, items = frames(spark, *corpus)
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0


# ---------------------------------------------------------------- hard negatives

def plain_mine(vectors, every=10, low=30, high=90):
    """(anchor, positive, rank, negative, positive score, negative score) for (id, label, vector) rows."""
    fit = [(n, i, y, [math.floor(256 * float(x)) for x in v]) for n, (i, y, v) in enumerate(vectors)
           if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, y, a in fit:
        if i is None or i % every:
            continue
        scored = [(-max(min(sum(p * q for p, q in zip(a, b)), 2**63 - 1), -2**63), j is None, j or 0, m, z) for m, j, z, b in fit if m != n and len(a) == len(b)]
        for s, null, j, _, z in sorted(x for x in scored if x[4] == y)[:5]:
            found = sorted(x for x in scored if x[4] != y and low * -s <= 100 * -x[0] <= high * -s)[:10]
            out += [(i, None if null else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(found, 1)]
    return sorted(out, key=key)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    made = [(i, int(rng.integers(4)), [float(x) for x in centers[rng.integers(6)] + 0.4 * rng.normal(size=8)]) for i in range(400)]
    copy = made[7][2]
    made += [(1000 + i, i % 3, copy) for i in range(150)]
    made += [(i, 1, [0.0] * 8) for i in (2000, 2001)] + [(2010, None, copy), (2020, 2, None), (2030, 2, [math.nan] * 8), (2040, 2, [None] + copy[1:]),
                                                         (2050, 2, [math.inf] * 8), (None, 0, copy), (None, 1, copy), (1010, 1, copy)]
    made += [(3000 + i, i % 2, [float(i % 7), 1.0, -2.0]) for i in range(25)]  # another length
    made += [(4000 + i, i % 2, []) for i in range(12)]
    made += [(5000 + i, i % 2, [1e17 * (i + 1)]) for i in range(12)]  # beyond 53 and 64 bits
    return made


def mined(spark, made, **more):
    df = spark.createDataFrame([(*m, 0, 0) for m in made], "vec_id bigint, label int, embedding array<double>, row int, dim int")
    out = hardneg.mine(df, F.col("label"), anchor=F.expr("coalesce(vec_id % 10 = 0, false)"), **more)
    return rows(out, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("shard_rows,anchor_rows,sample", [(65_536, 16_384, 4_096), (40, 7, 4_096), (100, 16_384, 30)])
def test_mining_equals_the_plain_version(spark, vectors, monkeypatch, shard_rows, anchor_rows, sample):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hardneg, "ANCHOR_ROWS", anchor_rows)
    monkeypatch.setattr(hardneg, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(hardneg, "CELL_ROWS", 8)
    monkeypatch.setattr(hardneg.Shard, "BATCH", 16)
    prepare(spark)
    got, want = mined(spark, vectors), plain_mine(vectors)
    assert got == want and len(want) > 1000


def test_mining_of_an_empty_table(spark):
    assert mined(spark, [(1, None, [1.0])]) == [] and mined(spark, [(10, 1, [1.0])]) == []


def test_cells_come_in_order_of_their_bounds_which_hold(vectors):
    x = np.floor(256 * np.array([v for _, _, v in vectors[:400]]))
    cells = hardneg.Cells(x, (hardneg.codebook(x[:, :4], 9), hardneg.codebook(x[:, 4:], 9)))
    for anchor in x[:20]:
        seen, last = 0, math.inf
        for bound, a, b in cells.visit(anchor):
            assert bound <= last and (cells.vectors[a:b] @ anchor <= bound).all()
            seen, last = seen + b - a, bound
        assert seen == len(x)


def test_certified_windows_leave_cells_out():
    """Far cells of a clustered table are never scored."""
    rng = np.random.default_rng(8)
    centers = 300 * rng.normal(size=(16, 8))
    x = np.floor(np.concatenate([c + 5 * rng.normal(size=(200, 8)) for c in centers]))
    ids = np.arange(len(x))
    shard = hardneg.Shard(ids, ids, ids % 2, x, (hardneg.codebook(x[:, :4], 16), hardneg.codebook(x[:, 4:], 16)))
    scored = []
    one = shard._score
    shard._score = lambda a, s: scored.append(sum(e - b for b, e in s)) or one(a, s)
    ident, score, _ = shard.positives(x[0], 0, 0, 5)
    assert sum(scored) < len(x) / 2
    full = x @ x[0]
    assert score.tolist() == sorted(full[(ids % 2 == 0) & (ids != 0)].astype(int).tolist(), reverse=True)[:5]


# ---------------------------------------------------------------- URL filter

def plain_parts(url):
    if url is None or "://" not in url:
        return "", "", url or ""
    scheme, rest = url.split("://", 1)
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    return host, re.match(r"[^?#]*", rest[len(raw):]).group(), f"{scheme}://{host}{rest[len(raw):]}"


def plain_judge(all_urls, rules):
    """(host, path, rule, verdict) per URL: the models as dictionaries."""
    import hashlib

    order, out, side = urls.ORDER, [], {}
    for u in all_urls:
        host, path, text = plain_parts(u)
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        rule, verdict = max(fit)[1:] if fit else (None, None)
        side[text] = verdict
        out.append((host, path, text, rule, verdict))
    check = {t: hashlib.md5(t.encode()).hexdigest()[0] in "012" for t in side}

    def windows(t):
        padded = "\x02" * order + t + "\x03"
        return [padded[i:i + order + 1] for i in range(len(t) + 1)]

    models = []
    for verdict in ("allow", "block"):
        follow = defaultdict(Counter)
        for t, v in side.items():
            if v == verdict and not check[t]:
                for w in windows(t):
                    for j in range(order + 1):
                        follow[w[order - j:order]][w[-1]] += 1
        models.append(follow)

    def p(follow, w):
        at = 1 / urls.ALPHABET
        for j in range(order + 1):
            c = follow.get(w[order - j:order])
            if c:
                at = (c[w[-1]] + len(c) * at) / (sum(c.values()) + len(c))
        return at

    def score(t):
        return math.floor(sum(math.floor(1e6 * (math.log(p(models[0], w)) - math.log(p(models[1], w))) + 0.5) for w in windows(t)) / len(windows(t)))

    held = [(score(t) // urls.BIN, side[t]) for t in side if check[t] and side[t]]
    a, r = (sum(v == x for _, v in held) for x in ("allow", "block"))
    least = 0
    if a and r:
        marks = range(min(0, *(b for b, _ in held)), max(0, *(b for b, _ in held)) + 2)
        least = min((-(sum(b >= m and v == "allow" for b, v in held) * r + sum(b < m and v == "block" for b, v in held) * a), abs(m), m) for m in marks)[2]
    return [(h, p_, rule, v or ("allow" if score(t) >= least * urls.BIN else "block")) for h, p_, t, rule, v in out]


ODD = [None, "", "no scheme/en/1", "http://", "http://Example.ORG/en/12?x=1#y", "http://www.example.org/es/", "http://example.org", "http://notexample.org/es/1",
       "http://org/x", "http://example.org?/es/", "http://x.com/fr/a://b.org/", "http://é.com/日本/ü", "http://a.com:80/fr/", "http://a.com/fr/" + "q" * 30_000,
       "HTTP://A.COM/FR/", "http://a.com/de/", "://org/", "http://x.org/\nline?"]


@pytest.fixture(scope="module")
def url_rows(spark):
    prepare(spark)
    given = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    return ODD + ODD[:6] + given + ["http://same.example.net/en/1"] * 200


def test_filter_equals_the_plain_version(spark, url_rows):
    clash = "rule string, verdict string, text string, u int, role string, Host string, score int"
    df = spark.createDataFrame([(i, u, *["x", "x", "x", 1, "x", "x", 1]) for i, u in enumerate(url_rows)], f"page_id bigint, url string, {clash}")
    out = urls.judge(df, RULES)
    assert out.columns == ["page_id", "url", "text", "u", "role", "host", "path", "rule", "score", "verdict"]
    got = [tuple(r) for r in out.orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    want = plain_judge(url_rows, RULES)
    assert got == want
    assert {v for _, _, r, v in want if r is None} == {"allow", "block"}


def test_models_tell_planted_kinds_apart(spark):
    """Ruled URLs of two kinds on many hosts teach the models; unruled ones are then judged by their spelling."""
    rng = np.random.default_rng(4)
    good, bad = ["river", "garden", "history", "museum"], ["casino", "jackpot", "betting", "xpills"]

    def made(words, end, n):
        return [f"https://site{rng.integers(40)}.{end}/{words[rng.integers(4)]}-{words[rng.integers(4)]}/{rng.integers(999)}" for _ in range(n)]

    all_urls = made(good, "org", 150) + made(bad, "biz", 150) + made(good, "net", 60) + made(bad, "net", 60)
    df = spark.createDataFrame(list(enumerate(all_urls)), "page_id bigint, url string")
    got = [r[0] for r in urls.judge(df, [("allow", "org/"), ("block", "biz/")]).orderBy("page_id").select("verdict").collect()]
    assert got[300:360] == ["allow"] * 60 and got[360:] == ["block"] * 60


def test_filter_without_ruled_urls_and_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id bigint, url string")
    assert rows(urls.judge(df, RULES), "page_id", "score", "verdict") == [(1, 0, "allow"), (2, 0, "allow")]
    assert rows(urls.judge(df, []), "page_id", "rule") == [(1, None), (2, None)]
    assert urls.judge(df.where("false"), RULES).count() == 0
