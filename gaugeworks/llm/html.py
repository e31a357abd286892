"""Main-text extraction: structure of the page, then repeats across the pages of a host.

Parsing cuts a page into text blocks and tells four kinds apart by the open
elements around them: *main* (inside article), *maybe* (inside article, but in a box
whose class or id has a boilerplate word as a part, as in ``share-box``), *chrome*
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments; by
element, role or class) and *open* (anything else). Scripts, styles and markup give
no blocks.

Main blocks are always text: a line of an article may also be a footer or advert of
its host. Repeats decide the rest on every page: a maybe block goes if one repeat
covers it whole; a page without any article is left with its open blocks less
everything repeats cover, also inside a block: the unique runs.

Repeats come from a suffix order per host over the tokens of all blocks of all pages, main
ones too, made in two rounds. The first tells the suffixes whose first ``MIN_TOKENS`` tokens
no other text of the host has: they have no repeat. Pages of a task form groups; a group sends
the sorted names (hashes) of its suffixes' first tokens by range, as differences, and gets
back a bit for each: whether another text has it. Equal tokens have equal names, so none is
missed; a name that is shared by chance is told apart in the second round. Of the shared
suffixes, one that has the same token before it wherever it stands on the host has the
repeats of the suffix before it, less a token, so one round of the tokens before tells which
have several; these, the first of a run and every (KEY_TOKENS - SEEN_TOKENS)th in between
enter the second round and decide for those behind them.

There a suffix has a key, its first ``KEY_TOKENS`` tokens as far as shared suffixes
go on without a break. Keys are dealt by host and first ``MIN_TOKENS`` tokens and sorted;
the common prefix with the nearest neighbours of another text is the longest repeat that
starts at a suffix, up to KEY_TOKENS. Neighbours that share less than MIN_TOKENS are no
repeat, so no repeat crosses a part. Lengths are told up to ``SEEN_TOKENS``; a longer repeat
is seen whole as well, as each of its suffixes but the last reaches SEEN_TOKENS.

Pages of a host with equal main, maybe and open text are copies and count as one page,
so a copied text is not boilerplate by its copies. If repeats cover all open or all
article blocks of a page, they do not tell its text and the blocks stay whole.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest repeat, in tokens, that counts as boilerplate.
MIN_TOKENS = 6
#: Tokens of a suffix that are its key in the order.
KEY_TOKENS = 32
#: Tokens up to which the longest repeat at a place is told.
SEEN_TOKENS = 16
#: Longer tokens stand in keys by their first characters and their hash, so keys are bounded.
TOKEN_CHARS = 64
#: Bytes of block text of a group of pages, about; a task holds one group.
GROUP_BYTES = 24 << 20
#: Suffixes whose first tokens are compared in one task, about.
PART_SUFFIXES = 1 << 23
#: Bits of the name of a suffix's first tokens beyond those that count the suffixes: with 7, at most 1 % are taken for shared and told apart by their keys.
SPARE_BITS = 7
#: Suffixes that are packed together on their way into the order.
PACKED_ROWS = 1 << 18
#: Bits of the name of the token before a suffix.
LEFT_BITS = 48
MAIN, MAYBE, CHROME, OPEN = KINDS = "main", "maybe", "chrome", "open"
_RNG = np.random.default_rng(6)
_BYTE = _RNG.integers(1 << 64, size=256, dtype=np.uint64)  # names are polynomials over these
_BYTE[10] = _BYTE[32]
_BASE = int(_RNG.integers(1 << 63, dtype=np.uint64)) * 2 + 1

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search "
    "section select summary svg table tbody td template tfoot th thead tr ul video audio canvas".split())
_CHROME_TAGS = frozenset(
    "head nav footer aside form menu dialog select button noscript iframe template svg object canvas video audio search".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_CHROME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr "
    "banner ad ads advert adverts advertisement advertising sponsor sponsored promo popup modal comment comments disqus reply replies "
    "respond newsletter subscribe share sharing social related".split())
# elements that hold text of their own: a word in a longer class name ("share-price") says nothing about them
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption blockquote pre span a b i em strong q cite abbr code time mark small sub sup".split())
_OWN_WORDS = frozenset("article post entry content title headline story".split())
_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
           "option": {"select"}, "p": _BLOCK - {"p"}}


def _is_chrome(name: str, attrs: str, in_main: bool) -> bool:
    if name in _CHROME_TAGS or name == "header" and not in_main:
        return True
    if "=" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if set(value.split()) & _CHROME_ROLES:
                return True
        elif name not in ("html", "body", "main"):
            for word in value.split():
                # in an article, and for text elements anywhere, the whole class has to be such a word
                parts = {word} if in_main or name in _TEXT_TAGS else set(re.split(r"[^a-z]+", word))
                if name == "article":  # readers' comments are often articles of their own
                    if word in ("comment", "comments", "reply"):
                        return True
                elif parts & _CHROME_WORDS and not parts & _OWN_WORDS:
                    return True
    return False


def _may_be_chrome(name: str, attrs: str) -> bool:
    """A box, not an element with text of its own, with a boilerplate word as a part of its class or id."""
    if "=" not in attrs or name not in _BLOCK or name in _TEXT_TAGS or name in ("article", "html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        if m[1].lower() != "role":
            for word in (m[2] or m[3] or m[4] or "").lower().split():
                parts = set(re.split(r"[^a-z]+", word))
                if parts & _CHROME_WORDS and not parts & _OWN_WORDS:
                    return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of the text blocks of a page, in order; white space is one space, references are decoded."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # element, kind inside it
    kind, at, n = OPEN, 0, len(page)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((kind, text))

    def pop_to(i: int) -> None:
        nonlocal kind
        del stack[i:]
        kind = stack[-1][1] if stack else OPEN

    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text = page[at:stop]
            parts.append(references.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if name not in _BLOCK and stack[i][0] in _BLOCK:
                    break
            continue
        if name in _RAW:
            if name != "title":
                parts.append(" ")
            end = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*(?:>|\Z)").search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
        if name in _BLOCK:
            flush()
            scopes = _CLOSES.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name and name in _CLOSES or stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in (scopes or _BLOCK):
                    break
        if name not in _VOID:
            inside = kind
            if kind != CHROME:
                if _is_chrome(name, m["attrs"], kind in (MAIN, MAYBE)):
                    inside = CHROME
                elif name == "article":
                    inside = MAIN if kind != MAYBE else MAYBE
                elif kind == MAIN and _may_be_chrome(name, m["attrs"]):
                    inside = MAYBE
            if inside != kind and name not in _BLOCK:
                flush()
            stack.append((name, inside))
            kind = inside
    flush()
    return out


def main_text(found: list[tuple[str, str]], repeats: list[tuple[int, int]] | None = None) -> str:
    """Main and maybe blocks less the maybe blocks that a repeat covers whole; without any, the open blocks less
    the tokens that repeats cover. ``repeats``: (first token, tokens up to SEEN_TOKENS) among the tokens of all blocks. If nothing
    is left, all of them."""
    length = dict(repeats or ())
    article = any(k in (MAIN, MAYBE) for k, _ in found)
    gone = {i for p, n in length.items() for i in range(p, p + n)} if not article else ()

    def whole(at: int, n: int) -> bool:
        if n > SEEN_TOKENS:
            return all(length.get(p, 0) >= SEEN_TOKENS for p in range(at, at + n - SEEN_TOKENS + 1))
        return any(p + length.get(p, 0) >= at + n for p in range(max(0, at + n - SEEN_TOKENS), at + 1))

    at, out = 0, []
    for kind, text in found:
        n = text.count(" ") + 1
        if kind == MAIN or kind == MAYBE and not whole(at, n):
            out.append(text)
        elif kind == OPEN and not article:
            left = [t for i, t in enumerate(text.split(" "), at) if i not in gone]
            if left:
                out.append(" ".join(left))
        at += n
    return "\n\n".join(out or [t for k, t in found if k in ((MAIN, MAYBE) if article else (OPEN,))])


def text_name(found: list[tuple[str, str]]) -> int:
    """Hash of the main, maybe and open blocks of a page; copies have the same."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest("\n".join(t for k, t in found if k != CHROME).encode("utf-8", "surrogatepass")) - (1 << 63)


def _key(tokens: list[str]) -> str:
    """Tokens of bounded length each, with a space behind each."""
    from xxhash import xxh3_128_hexdigest

    return "".join((t if len(t) <= TOKEN_CHARS else t[:TOKEN_CHARS - 33] + "\0" + xxh3_128_hexdigest(t.encode("utf-8"))) + " " for t in tokens)


def _common_prefixes(batches):
    """``(id, n)``: longest common prefix of a key, in tokens, with the keys before it that another text has.

    ``batches(id, host, key, lo, hi)`` are sorted by host, key, lo and hi, all rising or all falling; ``lo`` and ``hi`` are the first and last
    text that has the key. Held are the last key, its text (None: several have it) and its prefix with the last key of another.
    """
    last_host, last, text, other = None, [], None, 0
    for b in batches:
        ids, sizes = [], []
        for key_id, host, key, lo, hi in zip(*(b.column(c).to_pylist() for c in ("id", "host", "key", "lo", "hi"))):
            tokens = key.split(" ")[:-1]
            n = 0
            if host == last_host:
                for x, y in zip(tokens, last):
                    if x != y:
                        break
                    n += 1
                other = min(other, n) if text == lo else n  # a key that several texts have is of another than lo
            else:
                other = 0
            longest = other if lo == hi else len(tokens)
            if longest >= MIN_TOKENS:
                ids.append(key_id)
                sizes.append(longest)
            last_host, last, text = host, tokens, lo if lo == hi else None
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())], names=["id", "n"])


def _compressed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _packed(batches):
    """``(bucket, blob)`` of rows: sorted and compressed they take a third of the room in a shuffle."""
    def blobs(held):
        rows = pa.Table.from_batches(held).sort_by([("bucket", "ascending"), ("host", "ascending"), ("key", "ascending")]).combine_chunks()
        bucket = rows.column("bucket").to_numpy()
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = rows.drop_columns("bucket")
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([_compressed(rows.slice(i, j - i)) for i, j in zip(starts, [*starts[1:], len(bucket)])],
                                           pa.binary())], names=["bucket", "blob"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= PACKED_ROWS:
            yield blobs(held)
            held, size = [], 0
    if held:
        yield blobs(held)


def _unpacked(batches):
    for b in batches:
        for blob in b.column("blob"):
            yield from pa.ipc.open_stream(blob.as_buffer())


def longest_repeats(suffixes: DataFrame) -> DataFrame:
    """``(id, n)``: length in tokens, up to KEY_TOKENS, of the longest repeat that starts at a suffix, of ``suffixes(id, host, key, name)``.

    ``id`` stands for host and key, ``name`` for the text; each token of a key has a space behind it. A repeat has MIN_TOKENS
    tokens or more and stands in two texts of the host; ids without one are left out. Several ids may have the same key. With
    ``lo`` and ``hi`` instead of ``name``, a row stands for texts of which these are the least and greatest name.
    """
    lo, hi = ("lo", "hi") if "lo" in suffixes.columns else ("name", "name")
    tasks = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("host", F.substring_index("key", " ", MIN_TOKENS)), F.lit(tasks)).cast("int").alias("bucket")
    dealt = suffixes.select(bucket, "id", "host", "key", F.col(lo).alias("lo"), F.col(hi).alias("hi")) \
        .mapInArrow(_packed, "bucket int, blob binary").repartition(tasks, "bucket")
    found = dealt.mapInArrow(_unpacked, "id bigint, host string, key string, lo bigint, hi bigint")
    rising = found.sortWithinPartitions("host", "key", "lo", "hi").mapInArrow(_common_prefixes, "id bigint, n int")
    falling = found.sortWithinPartitions(*map(F.desc, ("host", "key", "lo", "hi"))).mapInArrow(_common_prefixes, "id bigint, n int")
    return rising.unionByName(falling).groupBy("id").agg(F.max("n").alias("n"))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _BASE and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            y = np.full(max(n, 1 << 18), x, np.uint64)
            y[0] = 1
            _POWERS[i] = np.cumprod(y)
    return _POWERS


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(_BASE)
    return (x ^ x >> np.uint64(29)) * np.uint64(_BASE) >> np.uint64(64 - bits)


class Group:
    """Pages of a task that travel together, and the suffixes of their tokens in order.

    ``page``, ``token`` and ``first``: number of the page, of the token a suffix starts with and name of its first MIN_TOKENS tokens;
    ``left``, if asked for: name of the token before it, 0 at the start of a page. ``order``: the names, rising, twice if two texts have them.
    Equal tokens have equal names; names of other tokens may be equal too.
    """

    def __init__(self, packed: bytes, bits: int, lefts: bool = False):
        from xxhash import xxh3_64_intdigest

        self.rows = pa.ipc.open_stream(packed).read_all()
        self.hosts, self.names = self.rows.column("host").to_pylist(), self.rows.column("name").to_pylist()
        texts = [x.encode() for x in self.rows.column("text").to_pylist()]
        salt = {h: xxh3_64_intdigest(h or "") for h in set(self.hosts)}
        salts = np.array([salt[h] for h in self.hosts], np.uint64)
        page, token, first, left, starts, ends = [], [], [], [], [], []
        i = tokens = size = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) < 1 << 17):
                n += len(texts[j]) + 1
                j += 1
            data = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", np.uint8)
            power, inverse = _powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * power[:n], out=total[1:])
            gap = np.flatnonzero((data == 32) | (data == 10))
            start = np.append(0, gap[:-1] + 1)
            start, end = start[gap > start], gap[gap > start]  # an empty page has no token
            of = (np.searchsorted(np.cumsum([len(x) + 1 for x in texts[i:j]]), start, "right") + i).astype(np.int32)
            if len(start) >= MIN_TOKENS:
                at = np.flatnonzero(of[MIN_TOKENS - 1:] == of[:1 - MIN_TOKENS])
                s = start[at]
                first.append(_mixed((total[end[at + MIN_TOKENS - 1] + 1] - total[s]) * inverse[s] + salts[of[at]], bits))
                if lefts:
                    before = np.maximum(at, 1) - 1
                    name = _mixed((total[s] - total[start[before]]) * inverse[start[before]], LEFT_BITS)
                    left.append(np.where((at > 0) & (of[before] == of[at]), np.maximum(name, 1), 0).astype(np.uint64))
                page.append(of[at])
                token.append((at + tokens).astype(np.int32))
            starts.append((start + size).astype(np.int32))
            ends.append((end + size).astype(np.int32))
            i, tokens, size = j, tokens + len(start), size + n
        self.data = b"\n".join(texts) + b"\n"
        self.offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
        empty = np.empty(0, np.int32)
        self.starts, self.ends, self.page, self.token = (np.concatenate([empty, *x]) for x in (starts, ends, page, token))
        self.first, self.left = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (first, left))
        number = {x: i for i, x in enumerate(dict.fromkeys(self.names))}
        own, rest = np.array([number[x] for x in self.names], np.uint64), np.uint64(64 - bits)
        pairs = self.first << rest | own[self.page]
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[:len(pairs)]] >> rest
        third = np.append([False, False], pairs[2:] == pairs[:-2])[:len(pairs)]  # a third text says no more than the second
        self.order = pairs[~third]

    def found(self, i: int) -> list[tuple[str, str]]:
        return [(KINDS[k], t) for k, t in zip(self.rows.column("kinds")[i].as_py(), self.rows.column("text")[i].as_py().split("\n"))]

    def shared(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes whose names are among the rising names ``marked``, and the places of these names there."""
        if not len(marked):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        shift = np.uint64(max(0, int(marked[-1]).bit_length() - 22))
        near = np.zeros(1 << 22, bool)
        near[marked >> shift] = True
        where = np.flatnonzero((self.first <= marked[-1]) & near[np.minimum(self.first >> shift, (1 << 22) - 1)])
        spot = np.searchsorted(marked, self.first[where])
        same = marked[spot] == self.first[where]
        return where[same], spot[same]

    def lefts(self, marked: np.ndarray) -> np.ndarray:
        """By marked name: the name of the token before it, 0 if there are several or a page starts."""
        where, spot = self.shared(marked)
        by = np.argsort(spot, kind="stable")
        return _one(spot[by], self.left[where[by]])

    def keys(self, marked: np.ndarray, open_left: np.ndarray):
        """Of the shared suffixes: the suffixes themselves, the suffix each depends on, how many tokens before, and by the suffixes that
        others depend on the number of their key in the keys; the keys as (host, key): [number, least name, greatest name].

        A suffix that always has the same token before it has the repeats of that one, less a token. A key ends with the last
        shared suffix of an unbroken run: no repeat goes on behind it."""
        where, spot = self.shared(marked)
        token = self.token[where]
        broken = np.append(True, np.diff(token) != 1)[:len(where)]
        places = np.arange(len(where))
        since = places - np.maximum.accumulate(np.where(broken | open_left[spot], places, 0)) if len(where) else places
        back = since % (KEY_TOKENS - SEEN_TOKENS)
        heads = np.flatnonzero(back == 0)
        last = np.flatnonzero(np.append(broken[1:], True)[:len(where)])
        size = np.minimum(token[last[np.searchsorted(last, heads)]] - token[heads] + MIN_TOKENS, KEY_TOKENS) if len(where) else heads
        keys: dict[tuple[str, str], list[int]] = {}
        numbers = []
        for i, s, e in zip(self.page[where[heads]].tolist(), self.starts[token[heads]].tolist(), self.ends[token[heads] + size - 1].tolist()):
            key = self.data[s:e].decode().replace("\n", " ")
            key, name = (self.hosts[i], key + " " if e - s <= TOKEN_CHARS else _key(key.split(" "))), self.names[i]
            x = keys.setdefault(key, [len(keys), name, name])
            x[1], x[2] = min(x[1], name), max(x[2], name)
            numbers.append(x[0])
        return where, np.searchsorted(heads, places - back), back, np.array(numbers, np.int64), keys


def _one(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """By distinct name of rising ``names``: the value, 0 if there are several."""
    if not len(names):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    least, most = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    return np.where(least == most, least, 0).astype(np.uint64)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers, their bytes by significance."""
    return len(numbers).to_bytes(4, "little") + pa.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unsqueezed(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(blob[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + pa.compress(np.packbits(flags).tobytes(), "zstd", asbytes=True)


def _flags(blobs: list[bytes]) -> np.ndarray:
    out = [np.empty(0, bool)]
    for x in blobs:
        n = int.from_bytes(x[:4], "little")
        out.append(np.unpackbits(np.frombuffer(pa.decompress(x[4:], -(-n // 8), "zstd", asbytes=True), np.uint8), count=n).astype(bool))
    return np.concatenate(out)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html)``.

    Null html is empty and gives an empty text; null urls share one nameless
    host; null ids are kept; repeated rows are kept and count as one page; an
    empty table gives an empty result; extra columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    kind = dict(pages.dtypes)["page_id"]
    most = (rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // 4 + 1  # suffixes, at most about
    cut = max(6, (most // PART_SUFFIXES).bit_length())  # the first bits of a name are its part
    bits = min(44, max(most.bit_length() + SPARE_BITS, cut + 1))

    def pack(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 12

        def group():
            packed = _compressed(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed], pa.binary())], names=["grp", "pack"])

        for b in batches:
            kinds, texts, names = [], [], []
            for page in b.column(3).to_pylist():
                found = blocks(page)
                kinds.append(bytes(KINDS.index(k) for k, _ in found))
                texts.append("\n".join(t for _, t in found).encode("utf-8"))
                names.append(text_name(found))
                size += 64 + len(texts[-1])
            held.append(pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + [pa.array(kinds, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(names, pa.int64())],
                                                   names=["page_id", "url", "host", "kinds", "text", "name"]))
            if size >= GROUP_BYTES:
                yield group()
                held, size, number = [], 0, number + 1
        if held:
            yield group()

    def by_part(grp, names, column, blobs):
        """A row per part that has some of the rising names, with what ``blobs`` makes of their range."""
        part = (names >> np.uint64(bits - cut)).astype(np.int32)
        starts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        return pa.table({"part": pa.array(part[starts[:-1]], pa.int32()), "grp": pa.array([grp] * (len(starts) - 1), pa.int64()),
                         column: pa.array([blobs(i, j) for i, j in zip(starts, starts[1:])], pa.binary())})

    def names(batches):
        for b in batches:
            for grp, packed in zip(b.column("grp").to_pylist(), b.column("pack")):
                order = Group(packed.as_py(), bits).order
                yield from by_part(grp, order, "names", lambda i, j: _squeezed(np.diff(order[i:j], prepend=np.uint64(0)))).to_batches()

    def twice(part: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By group, its names and a flag for each: whether it stands in two texts."""
        lists = [np.cumsum(_unsqueezed(x), dtype=np.uint64) for x in part.column("names").to_pylist()]
        order = np.sort(np.concatenate(lists))
        several = np.unique(order[1:][order[1:] == order[:-1]])
        return lists, [several[np.minimum(np.searchsorted(several, x), len(several) - 1)] == x if len(several) else np.zeros(len(x), bool) for x in lists]

    def mark(part: pa.Table) -> pa.Table:
        return pa.table({"grp": part.column("grp"), "part": part.column("part"), "shared": pa.array(map(_bits, twice(part)[1]), pa.binary())})

    def mark_open(part: pa.Table, left: pa.Table) -> pa.Table:
        """With a flag for each shared name: whether several tokens stand before it."""
        lists, flags = twice(part)
        before = dict(zip(left.column("grp").to_pylist(), left.column("lefts").to_pylist()))
        marked = [np.unique(x[f]) for x, f in zip(lists, flags)]
        lefts = [_unsqueezed(before[g]) if len(x) else np.empty(0, np.uint64) for g, x in zip(part.column("grp").to_pylist(), marked)]
        order, values = np.concatenate(marked), np.concatenate(lefts)
        by = np.argsort(order, kind="stable")
        distinct, several = np.unique(order), _one(order[by], values[by]) == 0
        return pa.table({"grp": part.column("grp"), "part": part.column("part"), "shared": pa.array(map(_bits, flags), pa.binary()),
                         "open_left": pa.array([_bits(several[np.searchsorted(distinct, x)]) for x in marked], pa.binary())})

    def opened(left: pa.Table, right: pa.Table, lefts: bool = False):
        """A group, the names marked in it, and which of them several tokens stand before."""
        (packed,) = left.column("pack").to_pylist()
        group = Group(packed, bits, lefts)
        marks = sorted((x for x in right.to_pylist() if x["part"] is not None), key=lambda x: x["part"])
        flags = _flags([x["shared"] for x in marks])
        if len(flags) != len(group.order):
            raise ValueError("a group of pages came back with other suffixes: the input differs from read to read")
        return left.column("grp")[0].as_py(), group, np.unique(group.order[flags]), _flags([x["open_left"] for x in marks if "open_left" in x])

    def before(left: pa.Table, right: pa.Table) -> pa.Table:
        grp, group, marked, _ = opened(left, right, True)
        lefts = group.lefts(marked)
        return by_part(grp, marked, "lefts", lambda i, j: _squeezed(lefts[i:j]))

    def suffixes_of(left: pa.Table, right: pa.Table) -> pa.Table:
        grp, group, marked, open_left = opened(left, right)
        keys = group.keys(marked, open_left)[-1]
        return pa.table({"id": pa.array([grp << 32 | x[0] for x in keys.values()], pa.int64()), "host": pa.array([h for h, _ in keys], pa.string()),
                         "key": pa.array([k for _, k in keys], pa.string()), "lo": pa.array([x[1] for x in keys.values()], pa.int64()),
                         "hi": pa.array([x[2] for x in keys.values()], pa.int64())})

    def decided(left: pa.Table, right: pa.Table) -> pa.Table:
        grp, group, marked, open_left = opened(left, right.filter(pc.is_valid(right.column("part"))))
        where, head, back, number, keys = group.keys(marked, open_left)
        told = right.filter(pc.is_valid(right.column("id")))
        length = np.zeros(len(keys), np.int64)
        length[told.column("id").to_numpy() & 0xFFFFFFFF] = told.column("n").to_numpy()
        n = np.minimum(length[number][head] - back, SEEN_TOKENS) if len(where) else where
        some = np.flatnonzero(n >= MIN_TOKENS)
        page = group.page[where[some]]
        places = group.token[where[some]] - np.searchsorted(group.starts, group.offsets[page])
        covered: dict[int, list[tuple[int, int]]] = {}
        for i, p, k in zip(page.tolist(), places.tolist(), n[some].tolist()):
            covered.setdefault(i, []).append((p, k))
        texts = [main_text(group.found(i), covered.get(i)) for i in range(len(group.names))]
        return group.rows.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))

    dealt = rows.select("page_id", "url", host.alias("host"), "html").mapInArrow(pack, "grp bigint, pack binary").repartition("grp")
    named = dealt.mapInArrow(names, "part int, grp bigint, names binary")
    shared = named.groupBy("part").applyInArrow(lambda t: mark(t), "grp bigint, part int, shared binary")
    lefts = dealt.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(lambda a, b: before(a, b), "part int, grp bigint, lefts binary")
    marks = named.groupBy("part").cogroup(lefts.groupBy("part")).applyInArrow(lambda a, b: mark_open(a, b), "grp bigint, part int, shared binary, open_left binary")
    suffixes = dealt.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(lambda a, b: suffixes_of(a, b), "id bigint, host string, key string, lo bigint, hi bigint")
    repeats = longest_repeats(suffixes).select(F.shiftright("id", 32).alias("grp"), "id", "n")
    known = marks.unionByName(repeats, allowMissingColumns=True)
    out = dealt.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(lambda a, b: decided(a, b), f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
