"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0 is the most frequent), so most
take one byte. A rank takes 1 to 4 little-endian bytes; the byte counts less
one are kept apart, four 2-bit codes to a control byte. A file is a sequence
of blocks, each closed by one line feed:

    magic 'GWT1', part u32, docs u32, ids u32   (little-endian)
    document numbers i64 x docs, null flags u8 x docs, lengths u32 x docs
    control bytes, ceil(ids / 4)
    data bytes

Decoding looks up each control byte in a 256-row table of four lengths and
gathers the values with numpy. The ranks are a small table beside the files.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, staged
from .tokens import token_ids

MAGIC = b"GWT1"
#: A block is closed once it holds this many ids (a document is never split).
BLOCK_IDS = 1 << 20
#: Ids a file holds on average; files stay far below the 2 GB that one read can take.
FILE_IDS = 6_000_000
_LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def encode_block(part: int, numbers: list, arrays: list[np.ndarray]) -> bytes:
    """One block of documents; ``arrays`` hold ranks (uint32)."""
    v = np.concatenate(arrays).astype("<u4") if arrays else np.zeros(0, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[:len(v)] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    head = MAGIC + np.array([part, len(numbers), len(v)], "<u4").tobytes()
    return b"".join([head, np.array([x or 0 for x in numbers], "<i8").tobytes(), bytes(x is None for x in numbers),
                     np.array([len(a) for a in arrays], "<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_file(content: bytes):
    """Yield ``(part, block, numbers, lengths, ranks)`` for each block of a file."""
    at, block = 0, 0
    while at < len(content):
        if content[at:at + 4] != MAGIC:
            raise ValueError(f"no token block at byte {at}")
        part, docs, n = np.frombuffer(content, "<u4", 3, at + 4).tolist()
        at += 16
        numbers = np.frombuffer(content, "<i8", docs, at).tolist()
        nulls = content[at + 8 * docs:at + 9 * docs]
        lengths = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        control = np.frombuffer(content, np.uint8, -(-n // 4), at)
        at += len(control)
        size = _LENGTHS[control].ravel()[:n]
        start = np.cumsum(size, dtype=np.int64) - size
        total = int(start[-1] + size[-1]) if n else 0
        data = np.frombuffer(content, np.uint8, total + 3, at) if at + total + 3 <= len(content) else np.concatenate(
            [np.frombuffer(content, np.uint8, total, at), np.zeros(3, np.uint8)])
        at += total
        if content[at:at + 1] != b"\n":
            raise ValueError(f"token block not closed at byte {at}")
        at += 1
        v = data[start].astype(np.uint32)
        for i in (1, 2, 3):
            more = np.flatnonzero(size > i)
            if len(more):
                v[more] |= data[start[more] + i].astype(np.uint32) << np.uint32(8 * i)
        yield part, block, [None if z else x for x, z in zip(numbers, nulls)], lengths, v
        block += 1


def _ranks(tokens: DataFrame, id_bytes: int) -> DataFrame:
    """``(id, rank)`` by falling count, then id; one row per id of the vocabulary in use."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            joined = b"".join(x for x in b.column(0).to_pylist() if x)
            here = np.bincount(np.frombuffer(joined, f"<u{id_bytes}"))
            if len(here) > len(total):
                here[:len(total)] += total
                total = here
            else:
                total[:len(here)] += here
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(tokens: DataFrame, path: str, id_col: str = "doc_id", id_bytes: int = 4) -> None:
    """Write ``(id_col, n_ids, ids)``, ids of ``id_bytes`` each, as token files in ascending id order below ``path``.

    ``path/files`` holds the blocks, ``path/ranks`` the table of ranks. The id
    column is a whole number; null ids come first; equal ids by their ids' bytes.
    """
    spark = tokens.sparkSession
    counted = [(r["id"], r["n"]) for r in _ranks(tokens, id_bytes).collect()]  # at most one row per id of the vocabulary
    order = [i for i, _ in sorted(counted, key=lambda x: (-x[1], x[0]))]
    spark.createDataFrame([(i, r) for r, i in enumerate(order)], "id bigint, rank bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    files = max(1, -(-sum(n for _, n in counted) // FILE_IDS))

    def encode(batches):
        part = TaskContext.get().partitionId()
        numbers, arrays, held = [], [], 0
        for b in batches:
            for number, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                numbers.append(number)
                arrays.append(rank_of[np.frombuffer(ids or b"", f"<u{id_bytes}")])
                held += len(arrays[-1])
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_block(part, numbers, arrays)], pa.binary())], names=["block"])
                    numbers, arrays, held = [], [], 0
        if numbers:
            yield pa.RecordBatch.from_arrays([pa.array([encode_block(part, numbers, arrays)], pa.binary())], names=["block"])

    blocks = tokens.select(F.col(id_col).cast("bigint").alias("number"), "ids") \
        .repartitionByRange(files, "number").sortWithinPartitions("number", "ids").mapInArrow(encode, "block binary")
    # the text writer copies the bytes as they are and closes each block with the separator
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/files")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decode token files: ``(doc_id, part, place, n_ids, ids)``; ``place`` is the ids before the row in its part.

    With ``digest`` the last column is ``ids_crc32 long`` instead, taken where the ids are decoded.
    """
    ranks = spark.read.schema("id bigint, rank bigint").parquet(f"{path}/ranks").collect()  # bounded by the vocabulary
    id_of = np.zeros(len(ranks), "<u4")
    for r in ranks:
        id_of[r["rank"]] = r["id"]

    column = "ids_crc32 bigint" if digest else "ids binary"

    def decode(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                before = 0
                for part, _, numbers, lengths, v in decode_file(content):
                    ids = id_of[v] if len(v) else v
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    whole, size = memoryview(ids.tobytes()), ids.itemsize
                    raw = [whole[s * size:e * size] for s, e in zip(starts.tolist(), ends.tolist())]
                    last = pa.array([crc32(x) for x in raw], pa.int64()) if digest else pa.array([bytes(x) for x in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int64()), pa.array(before + starts),
                         pa.array(lengths.astype(np.int64)), last],
                        names=["doc_id", "part", "place", "n_ids", column.split()[0]])
                    before += len(v)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/files")
    return files.select("content").mapInArrow(decode, f"doc_id bigint, part bigint, place bigint, n_ids bigint, {column}")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents, write them as token files and read those back.

    Returns per row: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. Null text is empty (the end id alone); null ids come first; rows
    that share an id keep one row each; an empty table gives an empty result;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    tokens = staged(token_ids(docs, vocabulary, "byte", id_col, text_col, id_bytes=2), "tokens")
    path = shared_path(spark, "tokenfiles")
    write_tokens(tokens, path, id_col, id_bytes=2)
    rows = read_tokens(spark, path, digest=True).select("doc_id", "part", "place", F.col("n_ids").alias("n_tokens"), "ids_crc32")
    rows = staged(rows, "tokenrows")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one number a file
    base, table = 0, []
    for p in sorted(sizes):
        table.append((p, base))
        base += sizes[p]
    bases = spark.createDataFrame(table, "part bigint, base bigint")
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part")


