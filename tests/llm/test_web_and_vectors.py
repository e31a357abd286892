"""WARC archives, main-text extraction and embedding near-duplicates against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import html, vectors, warc
from gaugeworks.llm.common import prepare, shared_path

SF = "/root/testdata/sf0.001"


def empty(df):
    return df.where("false")


# ---------------------------------------------------------------- WARC

FORGED = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:gaugeworks:page:666>\r\nContent-Length: 5\r\n\r\nHTTP!\r\n\r\n")


@pytest.fixture(scope="module")
def pages(spark):
    prepare(spark)
    copy = "<html>" + "same text " * 40 + "</html>"
    rows = [(1, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", copy), (5, "u", copy), (6, "u", copy), (7, "u", "short"), (8, "u", "short"),
            (9, "u", "before " + FORGED + " between " + FORGED * 3 + "after"), (10, "u", "WARC/1.1\r\n" * 2000), (11, "u", FORGED * 40 + "x" * 300_000 + FORGED),
            (12, "u", "tail WARC/1.1\r\n"), (13, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "no id")]
    rows += [(100 + i, "u", f"page {i} " * (i % 50)) for i in range(300)]
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, file int")


def plain_records(rows):
    """(id, bytes, digest, type, refers to) of (id, url, html) rows: the first of equal payloads in (id, url) order, nulls last, is the response."""
    seen, out = {}, []
    for i, u, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        raw = (t or "").encode()
        again = len(raw) >= 100 and t in seen
        seen.setdefault(t, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", seen[t] if again else None))
    return sorted(out, key=str)


def test_one_response_per_payload_with_null_and_repeated_ids(spark):
    """Equal payloads under repeated ids, null ids, other urls and null urls: one response each, all others revisit it."""
    prepare(spark)
    a, b, c, d = ("payload %s " % x * 30 for x in "abcd")
    rows = [(5, "u", a), (5, "u", a), (None, "u", a), (7, "u", a), (5, "v", a), (5, None, a), (None, "u", b), (None, "u", b), (None, None, b),
            (1, "u", c), (None, "u", c), (2, "u", d), (3, "x", "short"), (3, "x", "short")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, first string, digest int")
    got = warc.round_trip(df)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == plain_records(rows)
    assert got.where("record_type = 'response'").count() == 6


@pytest.mark.parametrize("split", ["128m", "700"])
def test_archives_round_trip_in_any_split(spark, pages, split):
    """Payloads hold magics and whole forged records; splits cut records and magics anywhere."""
    path = shared_path(spark, "warc-test")
    some = pages if split == "128m" else pages.where("page_id <= 12 and page_id <> 11 or page_id is null")
    warc.write_archive(some.coalesce(2), path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read_archive(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(r["verified"] for r in got)
    want = plain_records([(r["page_id"], r["url"], r["html"]) for r in some.collect()])
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert {r["record_type"] for r in got} == {"response", "revisit"}


def test_archive_is_a_plain_warc_file(spark, pages):
    path = shared_path(spark, "warc-plain")
    warc.write_archive(pages.where("page_id in (1, 4, 5)").coalesce(1), path)
    raw = bytes(spark.read.format("binaryFile").load(path).where("path like '%part-%'").first()["content"])
    at, kinds = 0, []
    while at < len(raw):
        assert raw.startswith(b"WARC/1.1\r\n", at)
        head = warc.parse_header(raw[at + 10:])
        kinds.append(head["kind"])
        at += 10 + head["head"] + head["length"]
        assert raw[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert sorted(kinds) == ["response", "response", "revisit"] and b"X: y" not in raw.split(b"\r\n")


def test_empty_archive(pages):
    assert warc.round_trip(empty(pages)).count() == 0


def test_pointer_jumping_keeps_the_chain_only(spark):
    chain = [(1, i * 10, i * 10 + 10) for i in range(200)] + [(1, 15, 30), (1, 2005, 2010), (2, 5, 10), (3, 0, 7), (3, 7, 9_999)]
    links = spark.createDataFrame(chain, "file bigint, off bigint, next bigint")
    got = {tuple(r) for r in warc.reachable(links).collect()}
    assert got == {(1, i * 10) for i in range(200)} | {(3, 0), (3, 7)}


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header>Top</header><nav><ul><li>Home<li>News</ul></nav><!-- <article>no</article> --><div class="ad">Buy &lt;now&gt;</div>
<article class="post comment-free"><h1>A&nbsp;head   line</h1><p class=lead>One &amp;  two<br>three <b>b</b>old &#233;&#x4e2d;&copy<p>Next
 line <span>in</span>side &am<aside>side</aside><div class='notice big'>Cookies</div><form><input value="x>y">Mail</form><script>if (a < b) x</script>
<table><tr><td>c1<td>c2</table><p>last</p><section id="comments"><p>reader says</p></section></article><div id=sidebar>bar</div><footer>&copy; foot</footer></body></html>"""


def test_blocks_of_a_page():
    found = html.blocks(PAGE)
    assert html.main_text(found) == "A head line\n\nOne & two three bold é中©\n\nNext line inside &am\n\nc1\n\nc2\n\nlast"
    assert [t for k, t in found if k == html.CHROME] == ["Top", "Home", "News", "Buy <now>", "side", "Cookies", "Mail", "reader says", "bar", "© foot"]
    assert html.blocks("") == [] and html.blocks("a<b") == [("open", "a")] and html.blocks("<") == [("open", "<")]
    assert html.main_text(html.blocks("<article><p><b>T.<br><p>x</p></article><p>out")) == "T.\n\nx"


def test_extraction_keeps_unique_runs_only(spark):
    prepare(spark)
    foot = "all rights are reserved by the owner of this site"
    rows = [(i, "http://h.example/" + str(i), f"<div>own words of page {i} that no other page has at all {i}</div><div>{foot}</div>") for i in range(5)]
    rows += [(10, "http://h.example/a", f"<article><p>{foot}</p><p>body</p></article><footer>x</footer>"), (11, "http://other.example/", f"<p>{foot}</p>"),
             (12, None, None), (13, "u", ""), (None, "u", "<article>a<p>b</article>"), (10, "http://h.example/a", f"<article><p>{foot}</p><p>body</p></article><footer>x</footer>")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "page_id bigint, url string, html string, row int, text string")
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["text"], r["n_chars"]) for r in html.extract(df).collect()))
    want = [(-1, "a\n\nb")] + [(i, f"own words of page {i} that no other page has at all {i}") for i in range(5)]
    want = [(-1, "a\n\nb"), (0, ""), *[]][:1] + [(i, t) for i, t in want[1:]]
    body = f"{foot}\n\nbody"
    tail = [(10, body), (10, body), (11, foot), (12, ""), (13, "")]
    # "own words of page" is 4 tokens, shorter than a repeat; "that no other page has at all" is repeated and 7 long
    want = [(i, t.replace(" that no other page has at all", "")) for i, t in want]
    assert got == [(i, t, len(t)) for i, t in want + tail]
    assert html.extract(empty(df)).count() == 0


def test_a_word_inside_a_class_name_does_not_cost_an_article_its_text():
    page = ('<article><p class="notice-period">The notice period is a month.</p><p class="share-price">The share price rose.</p><div class="header-text">Top.</div>'
            '<div class="share">Share this</div><p class="comment">nice</p><p>End.</p></article><div class="ad-box">Buy</div><aside>x</aside>')
    assert html.main_text(html.blocks(page)) == "The notice period is a month.\n\nThe share price rose.\n\nTop.\n\nEnd."
    bare = '<main><p class="share-price">The share price rose.</p><div class="related-posts">More of this</div><div class="ad-box">Buy</div></main>'
    assert html.main_text(html.blocks(bare)) == "The share price rose."


def test_copies_of_a_text_do_not_empty_each_other(spark):
    prepare(spark)
    foot, copied = "all rights are reserved by the owner of this site", "a whole text that somebody put on two pages without any element that says so"
    rows = [(i, f"http://h/{i}", f"<nav>{'menu ' * i}</nav><p>{copied}</p><p>{foot}</p>") for i in (1, 2)]
    rows += [(3, "http://h/3", f"<p>a page of its own</p><p>{foot}</p>"), (4, "http://i/4", f"<p>{copied}</p><p>{foot}</p>"),
             (5, "http://i/5", f"<p>{copied}</p>"), (6, "http://i/6", f"<p>{foot}</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: copied, 2: copied, 3: "a page of its own", 4: f"{copied}\n\n{foot}", 5: copied, 6: foot}


def test_windows_cover_what_maximal_repeats_cover(spark):
    """Against the longest common run of every pair of places of two pages."""
    prepare(spark)
    rng = np.random.default_rng(5)
    runs = ["".join(f"{w} " for w in rng.integers(0, 4, n)) for n in (3, 5, 6, 7, 9, 14, 20)]
    texts = [" ".join(f"u{i}x{j} " + runs[k] for j, k in enumerate(rng.integers(0, len(runs), 5))).split() for i in range(12)]
    want = {}
    for i, x in enumerate(texts):
        gone = set()
        for y in texts[:i] + texts[i + 1:]:
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= html.MIN_TOKENS:
                        gone.update(range(p, p + n))
        want[i] = " ".join(t for p, t in enumerate(x) if p not in gone)
    df = spark.createDataFrame([(i, "http://h/", f"<p>{' '.join(x)}</p>") for i, x in enumerate(texts)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == want


def test_suffix_order_gives_the_longest_repeats(spark):
    """Against every pair of places of two texts of a host; equal texts are one, repeats are seen up to the length of a key."""
    prepare(spark)
    rng = np.random.default_rng(8)
    runs = [list(rng.choice(["a", "b", "ab", "a\x01", "é"], n)) for n in (4, 6, 8, 15, 16, 17, 40)]
    texts = [("h" if i % 3 else "g", [t for j in rng.integers(0, len(runs), 4) for t in [f"u{rng.integers(0, 9)}", *runs[j]]]) for i in range(14)]
    texts.append(("h", ["a"] * 50))
    rows, want = [], {}
    for i, (host, x) in enumerate(texts):
        for p in range(len(x) - html.MIN_TOKENS + 1):
            longest = 0
            for j, (other, y) in enumerate(texts):
                if j != i and other == host:
                    for q in range(len(y)):
                        n = 0
                        while n < html.KEY_TOKENS and p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                            n += 1
                        longest = max(longest, n)
            key = "".join(t + " " for t in x[p:p + html.KEY_TOKENS])
            rows += [(hash((host, key)), host, key, i)] * 2
            if longest >= html.MIN_TOKENS:
                want[hash((host, key))] = longest
    found = html.longest_repeats(spark.createDataFrame(rows, "id bigint, host string, key string, name bigint")).collect()
    assert {r["id"]: r["n"] for r in found} == want and len(found) == len(want) > 100


def test_repeats_decide_boxes_inside_articles(spark):
    """A box with a boilerplate word in its class goes where one repeat covers it whole; its own words and plain paragraphs stay."""
    prepare(spark)
    box = "pass this page on to your friends by mail or by letter"
    long = " ".join(f"term{i}" for i in range(40))
    kept = "a paragraph that stands in two articles word for word"
    rows = [(i, f"http://h/{i}", f'<article><p>{kept}</p><p>Story {i}.</p><div class="share-box"><p>{box}</p></div><div class="notice-box">{long}</div>'
             f'<div class="share-price">On day {i} the price was {i} and nobody knew why it rose.</div><p>End {i}.</p></article>') for i in (1, 2)]
    rows.append((3, "http://i/3", f'<article><p>{kept}</p><div class="share-box">{box}</div></article>'))  # another host: no repeat
    rows += [(i, f"http://j/{i}", f'<article><div class="share-box">{box}</div></article><p>{i}</p>') for i in (4, 5)]  # nothing else: stays
    rows += [(6, "http://k/6", f'<article><p>x</p><div class="share-box">{box} {long}</div></article>'),  # its parts are repeats, the whole is none
             (7, "http://k/7", f"<p>{box}</p><p>y</p><p>{long}</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    day = "On day {0} the price was {0} and nobody knew why it rose."
    assert got == {**{i: f"{kept}\n\nStory {i}.\n\n{day.format(i)}\n\nEnd {i}." for i in (1, 2)}, 3: f"{kept}\n\n{box}", 4: box, 5: box,
                   6: f"x\n\n{box} {long}", 7: "y"}


def test_article_text_is_in_the_suffix_order(spark, monkeypatch):
    """Text of an article is a repeat for pages without one and for boxes, and articles alone go through the order as well."""
    prepare(spark)
    lead, line = "the river rose by two metres in one night", "a paragraph that stands in two articles word for word"
    rows = [(1, "http://h/1", f"<article><p>{lead}</p><p>One.</p></article>"), (2, "http://h/2", f"<p>{lead}</p><p>news of the day</p>"),
            (3, "http://i/3", f"<article><p>{lead}</p></article>"), (4, "http://i/4", f'<article><p>Four.</p><div class="related-box">{lead}</div></article>'),
            (5, "http://j/5", f"<article><p>{line}</p></article>"), (6, "http://j/6", f"<article><p>{line}</p><p>Six.</p></article>"),
            (7, "http://k/7", "<p>a b</p>"), (8, "http://k/8", "")]
    seen, order = [], html.longest_repeats
    monkeypatch.setattr(html, "longest_repeats", lambda suffixes: seen.extend(r["key"] for r in suffixes.collect()) or order(suffixes))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert got == {1: f"{lead}\n\nOne.", 2: "news of the day", 3: lead, 4: "Four.", 5: line, 6: f"{line}\n\nSix.", 7: "a b", 8: ""}
    assert any(key.startswith(line[:40]) for key in seen)


def test_extraction_against_every_pair_of_places(spark):
    """All kinds of blocks, repeats longer than a key, several tokens before equal runs, copies and long tokens."""
    prepare(spark)
    rng = np.random.default_rng(11)
    runs = [" ".join(rng.choice(["a", "b", "é", "t" * 70, "t" * 70 + "u"], n)) for n in (5, 6, 7, 9, 16, 17, 33, 70)]
    marks = ["<article><p>{}</p></article>", '<article><p>x</p><div class="share-box">{}</div></article>', "<nav>{}</nav>", "<p>{}</p>", "<div>{}</div>"]
    pages = []
    for i in range(26):
        text = "".join(marks[k if i % 3 else max(k, 2)].format(" ".join(([f"u{i}"] if rng.random() < 0.6 else []) + [runs[j] for j in rng.integers(0, len(runs), 1 + k % 2)]))
                       for k in rng.integers(0, len(marks), 4))
        pages += [("h" if i % 4 else "g", text)] * (2 if i % 5 == 0 else 1)
    found = [html.blocks(page) for _, page in pages]
    tokens = [[t for _, text in f for t in text.split()] for f in found]
    want = []
    for i, x in enumerate(tokens):
        longest = [0] * len(x)
        for j, y in enumerate(tokens):
            if pages[i][0] == pages[j][0] and html.text_name(found[i]) != html.text_name(found[j]):
                row = [0] * (len(y) + 1)
                for p in range(len(x) - 1, -1, -1):
                    row = [row[q + 1] + 1 if x[p] == y[q] else 0 for q in range(len(y))] + [0]
                    longest[p] = max(longest[p], *row)
        want.append(html.main_text(found[i], [(p, min(n, html.SEEN_TOKENS)) for p, n in enumerate(longest) if n >= html.MIN_TOKENS]))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", page) for i, (h, page) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df.repartition(6)).collect()}
    assert [got[i] for i in range(len(pages))] == want
    assert sum(w != html.main_text(f) for w, f in zip(want, found)) > 8


def test_extraction_of_the_pages_table(spark):
    prepare(spark)
    df = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html.extract(df).join(df.select("page_id", "html"), "page_id").collect():
        body = r["html"][r["html"].index("<article>"):r["html"].index("</article>")]
        want = " ".join(html.references.unescape(html.re.sub("<[^>]*>", " ", body)).split())
        assert " ".join(r["text"].split()) == want and r["n_chars"] == len(r["text"])


# ---------------------------------------------------------------- embeddings

def plain_links(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, comp = {}, {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    return {i: (links.get(i, 0), find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize("bucket_rows", [2_048, 16])
def test_vector_links_match_brute_force(spark, monkeypatch, bucket_rows):
    """Clusters, exact copies and unusable vectors; whole buckets and buckets split into chunk pairs."""
    prepare(spark)
    monkeypatch.setattr(vectors, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(120)]
    center = rng.normal(size=16)
    rows += [(1000 + i, (center + rng.normal(size=16) * 0.03).tolist()) for i in range(150)]
    rows += [(2000 + i, (2.5 * center).tolist()) for i in range(60)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16),
             (3006, [1.0, 0.0]), (3007, [2.0, 0.0]), (3008, [-1.0, 0.0]), (3009, [1e200, 0.0]), (3010, [1e-200, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, rep int, mult int")
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    want = plain_links([(i, v if v is None or max(map(abs, [x or 0 for x in v]), default=0) in (0,) or i < 3000 else [None if x is None else x / 1e200 if abs(x) == 1e200 else x * 1e200 if abs(x) == 1e-200 else x for x in v]) for i, v in rows])
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= there and found >= 0.97 * there and all(got[k][0] <= want[k][0] for k in got)


def test_tables_follow_the_number_of_vectors():
    """Buckets stay as full and pairs as likely to meet, whatever the size of the table."""
    for n in (1, 500, 50_000, 400_000_000):
        bits, tables = vectors.layout(n, 0.95)
        meet = 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables
        assert meet >= vectors.RECALL and n / 2 ** bits <= vectors.BUCKET_FILL
    assert vectors.layout(50_000, 0.95) == (10, 13) and vectors.layout(400_000_000, 0.95) == (23, 59)


def test_vectors_of_the_table_and_odd_rows(spark):
    prepare(spark)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    want = plain_links(rows)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())
    twice = vectors.near_duplicates(df.unionByName(df.where("vec_id = 3")).unionByName(df.where("vec_id = 3").withColumn("vec_id", F.lit(None).cast("bigint"))))
    assert twice.count() == df.count() + 2
    assert {r["n_links"] for r in twice.where("vec_id = 3").collect()} == {got[3][0] + 2}
    assert vectors.near_duplicates(empty(df)).count() == 0
