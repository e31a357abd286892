"""WARC archives: writer, and a reader that verifies boundary chains.

Writing. Each page is one WARC/1.1 record whose block is an HTTP response with
the html as payload. Of records with equal payloads of at least
``REVISIT_BYTES`` the smallest page id is the response, the others are revisits
that refer to it. A record ends with two CR LF, which the text writer's line
separator supplies, so the files are plain ``.warc`` content written by Spark's
own committer on any file system.

Reading. Files are read as pieces between magics (``WARC/1.1`` CR LF) in splits of
any size; the split totals give each piece its byte offset. Every piece whose
header parses is a candidate record with an offset and the offset of its
successor, by its Content-Length. A payload may hold the magic, even a whole
forged record, so candidates prove nothing. Candidates of a split that follow
each other without a gap are one run: the chain that enters a run passes all that
is left of it. Pointer jumping over runs, from offset 0 of each file, doubles
the reach per round, and only records reached that way are kept. A record whose
payload holds a magic lies in several pieces; for those, and only if there are
any, a second pass gathers the pieces of its span.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, shared_path, staged

MAGIC = "WARC/1.1\r\n"
REVISIT_BYTES = 100
RECORD_ID = "urn:gaugeworks:page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Width of the byte ranges that match pieces to the records whose spans cover them.
_RANGE = 1 << 16
_HEADER = re.compile(rb"\A((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
_FIELDS = "page_id bigint, kind string, digest string, refers_to bigint"


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write one record per row of ``pages(page_id, url, html)`` below ``path``.

    Of rows with an equal payload of REVISIT_BYTES or more one is the response: that with the smallest
    page id, null ids last, equal ids by url; all others revisit it, further rows of the same id
    and url among them. A revisit of a response without an id refers to no number. Null html is an
    empty payload; white space and control characters of a url are percent-encoded; a null url has
    no target field; a null page id gives an empty record number.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("size", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    slim = base.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    # null ids last: a struct with the null flag in front
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    first = slim.groupBy("digest").agg(F.min(place)["page_id"].alias("first"), F.min_by("n", place).alias("same"), F.sum("n").alias("n")).where("n > 1")
    first = staged(first.select("digest", "first", (F.col("same") > 1).alias("tied")), "warc-copies")
    # the payloads are shuffled only if the copied ones are too many to send to every executor
    rows = base.join(broadcast_if_small(first, 96), "digest", "left").withColumn("copied", F.col("tied").isNotNull())
    plain = rows.where("not coalesce(tied, false)").withColumn("revisit", F.col("copied") & ~F.col("page_id").eqNullSafe(F.col("first")))
    # several rows hold the smallest id: equal rows are counted, so a group of copies is one row until it is written
    alike = rows.where("tied").groupBy("digest", "page_id", "url").agg(F.first("html").alias("html"), F.first("size").alias("size"), F.first("first").alias("first"),
                                                                       F.count("*").alias("n"))
    alike = staged(alike, "warc-ties")
    lead = alike.where(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("digest") \
        .agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url"))["url"].alias("lead"))
    alike = alike.join(broadcast_if_small(staged(lead, "warc-leads"), 512), "digest").withColumn("copied", F.lit(True))
    alike = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    chosen = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("lead")) & (F.col("nth") == 1)
    cols = ["page_id", "url", "html", "size", "digest", "first", "revisit"]
    rows = plain.select(*cols).unionByName(alike.withColumn("revisit", ~chosen).select(*cols))
    revisit = F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{RECORD_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{RECORD_ID}"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length,
        F.lit("\r\n\r\n"), http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _number(field: bytes) -> int | None:
    m = re.search(re.escape(RECORD_ID.encode()) + rb"(-?\d+)>", field)
    return int(m[1]) if m else None


def parse_header(piece: bytes) -> dict | None:
    """Fields of a record whose text after the magic is ``piece``; None if it is no record."""
    m = _HEADER.match(piece)
    if not m:
        return None
    fields = {}
    for line in m[1].split(b"\r\n")[:-1]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if b"warc-type" not in fields or not length.isdigit():
        return None
    return {"head": m.end(), "length": int(length), "kind": fields[b"warc-type"].decode("ascii", "replace"),
            "page_id": _number(fields.get(b"warc-record-id", b"")), "refers_to": _number(fields.get(b"warc-refers-to", b"")),
            "digest": fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("ascii", "replace")}


def payload_of(block: bytes) -> tuple[int | None, bytes]:
    """Content-Length and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", head)
    return int(m[1]) if m else None, body


def _pieces(spark: SparkSession, path: str, raw: bool) -> DataFrame:
    """Pieces with their place in the split, as parsed candidates or, with ``raw``, as bytes."""
    text = spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))

    def scan(batches):
        place, at, run, expected = None, 0, 0, None
        for b in batches:
            out = {c: [] for c in ("local", "size", "next", "run", "whole", "page_id", "kind", "digest", "refers_to", "payload_bytes", "payload_sha")}
            for file, split, piece in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, split) != place:
                    place, at, expected = (file, split), 0, None
                head = None if raw else parse_header(piece)
                out["local"].append(at)
                out["size"].append(len(piece))
                here, at = at, at + len(piece) + len(MAGIC)
                if raw:
                    continue
                run = run if here == expected else here
                length = head["head"] + head["length"] + len(MAGIC) + 4 if head else None
                expected = here + length if head else None
                whole = head is not None and len(piece) >= head["head"] + head["length"]
                n, sha = None, None
                if whole:
                    n, body = payload_of(piece[head["head"]:head["head"] + head["length"]])
                    if head["kind"] != "revisit":
                        n, sha = len(body), hashlib.sha256(body).hexdigest()
                head = head or {}
                out["next"].append(length)
                out["run"].append(run)
                out["whole"].append(whole)
                for c in ("page_id", "kind", "digest", "refers_to"):
                    out[c].append(head.get(c))
                out["payload_bytes"].append(n)
                out["payload_sha"].append(sha)
            cols = [b.column(0), b.column(1), pa.array(out["local"], pa.int64()), pa.array(out["size"], pa.int64())]
            names = ["file", "split", "local", "size"]
            if raw:
                cols, names = [*cols, b.column(2)], [*names, "piece"]
            else:
                cols += [pa.array(out["next"], pa.int64()), pa.array(out["run"], pa.int64()), pa.array(out["whole"], pa.bool_()), pa.array(out["page_id"], pa.int64()),
                         pa.array(out["kind"], pa.string()), pa.array(out["digest"], pa.string()), pa.array(out["refers_to"], pa.int64()),
                         pa.array(out["payload_bytes"], pa.int64()), pa.array(out["payload_sha"], pa.string())]
                names += ["next", "run", "whole", "page_id", "kind", "digest", "refers_to", "payload_bytes", "payload_sha"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rest = "piece binary" if raw else f"next bigint, run bigint, whole boolean, {_FIELDS}, payload_bytes bigint, payload_sha string"
    return text.mapInArrow(scan, f"file bigint, split bigint, local bigint, size bigint, {rest}")


def _placed(pieces: DataFrame, bases: DataFrame) -> DataFrame:
    """Pieces with ``off``: the byte offset of the magic in front of each."""
    return pieces.join(bases, ["file", "split"]).withColumn("off", F.col("base") + F.col("local") - len(MAGIC)).drop("base")


def _split_bases(pieces: DataFrame) -> DataFrame:
    totals = pieces.groupBy("file", "split").agg(F.max(F.col("local") + F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))


def reachable(links: DataFrame) -> DataFrame:
    """``(file, off)`` reached from offset 0 of each file over ``links(file, off, next)``, by pointer jumping."""
    nodes = links.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("reached")).checkpoint()
    while True:
        hit = nodes.where("reached").select("file", F.col("jump").alias("off"), F.lit(True).alias("hit")).distinct()
        far = nodes.select("file", F.col("off").alias("jump"), F.col("jump").alias("far"))
        step = nodes.join(hit, ["file", "off"], "left").join(far, ["file", "jump"], "left").select(
            "file", "off", F.coalesce("far", "jump").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"),
            F.col("far").isNotNull().alias("moved")).checkpoint()
        nodes = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return nodes.where("reached").select("file", "off")


def _on_chain(found: DataFrame) -> DataFrame:
    """The candidates ``found(file, off, next, run, ...)`` on the chain from offset 0 of their file."""
    runs = found.groupBy("file", "run").agg(F.max("next").alias("entry"))
    land = found.select("file", F.col("off").alias("entry"), F.col("run").alias("to"))
    edges = runs.join(land, ["file", "entry"], "left").checkpoint()
    reached = reachable(edges.select("file", F.col("run").alias("off"), F.coalesce("to", F.lit(-1)).alias("next")))
    entries = edges.join(reached.withColumnRenamed("off", "run"), ["file", "run"]).where("to is not null").select("file", F.col("to").alias("run"), "entry")
    starts = reached.where("off = 0").select("file", F.col("off").alias("run"), F.lit(0).cast("bigint").alias("entry"))
    entries = entries.unionByName(starts).groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return found.join(entries, ["file", "run"]).where("off >= entry").drop("entry")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.

    Columns: page_id, payload_bytes, payload_digest (of the full payload; a
    revisit states both in its header), record_type, refers_to (null unless a
    revisit), verified (the header's digest is that of the payload read).
    """
    pieces = staged(_pieces(spark, path, raw=False), "warc-pieces")
    bases = _split_bases(pieces)
    found = _placed(pieces.where("next is not null"), bases).where("off >= 0")
    found = staged(found.withColumn("next", F.col("off") + F.col("next")).withColumn("run", F.col("off") + F.col("run") - F.col("local")), "warc-candidates")
    records = _on_chain(found)
    columns = ["page_id", "kind", "digest", "refers_to", "payload_bytes", "payload_sha"]
    whole = records.where("whole").select(*columns)
    broken = staged(records.where("not whole"), "warc-broken")
    if broken.limit(1).count():
        whole = whole.unionByName(_gather(spark, path, bases, broken).select(*columns))
    revisit = F.col("kind") == "revisit"
    return whole.select(
        "page_id", "payload_bytes", F.when(revisit, F.col("digest")).otherwise(F.col("payload_sha")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        (revisit | (F.col("digest") == F.col("payload_sha"))).alias("verified"))


def _gather(spark: SparkSession, path: str, bases: DataFrame, broken: DataFrame) -> DataFrame:
    """Records that lie in several pieces, put together from all pieces in their span."""
    spans = broken.select("file", F.col("off").alias("start"), "next", F.explode(
        F.expr(f"sequence(off div {_RANGE}, (next - 1) div {_RANGE})")).alias("range"))
    parts = _placed(_pieces(spark, path, raw=True), bases).where("off >= 0").withColumn("range", F.expr(f"off div {_RANGE}"))
    inside = parts.join(spans, ["file", "range"]).where("off >= start and off < next").select("file", "start", "off", "piece")

    def join_pieces(t: pa.Table) -> pa.Table:
        order = t.column("off").to_numpy().argsort()
        pieces = t.column("piece").to_pylist()
        body = MAGIC.encode().join(pieces[i] for i in order)
        head = parse_header(body)
        block = body[head["head"]:head["head"] + head["length"]]
        n, payload = payload_of(block)
        sha = None
        if head["kind"] != "revisit":
            n, sha = len(payload), hashlib.sha256(payload).hexdigest()
        return pa.table({"page_id": pa.array([head["page_id"]], pa.int64()), "kind": [head["kind"]], "digest": [head["digest"]],
                         "refers_to": pa.array([head["refers_to"]], pa.int64()), "payload_bytes": pa.array([n], pa.int64()),
                         "payload_sha": pa.array([sha], pa.string())})

    # one group is one record
    return inside.groupBy("file", "start").applyInArrow(lambda t: join_pieces(t), f"{_FIELDS}, payload_bytes bigint, payload_sha string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back.

    One row per row of ``pages``; empty tables give empty results; extra columns
    are ignored.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
