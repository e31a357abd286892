"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped (a space becomes U+2581, one is put in front) and falls apart
into units: a run of U+2581 and either the plain letters or the other characters
that follow it. No piece goes beyond a unit (checked when the vocabulary is read),
so equal units have equal cuts wherever they stand, and only distinct units are
worked on:

1. explode each unit's substrings of at most the longest piece's length,
2. equi-join them to the piece table (its size is that of the vocabulary),
3. group the matches by unit: the edges of its lattice,
4. fold the lattice with Spark's higher-order ``aggregate``.

Two folds: ``viterbi`` for unigram tables (best sum of scores per position, then
back along the best edges) and ``merge`` for BPE tables, whose scores are merge
ranks and whose library does not maximise their sum: each step joins the two
neighbours whose piece has the best score, the leftmost among equals, until no
edge spans exactly two. Its state is one 64-bit mask of the places still cut.

Documents are packed into compressed blobs and dealt to parts of bounded bytes; a part
meets the cuts of its own distinct units only and maps its texts to ids. Tasks hold texts, units and
ids as Arrow columns and cut them at byte offsets, so no unit becomes a Python object. Units over
``UNIT_CHARS`` characters (no place for them in the mask) are merged in the task with a heap.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
UNIT_CHARS = 62
#: Text bytes of a part; a part's blobs, units, ids and decoded texts are held in memory together.
PART_BYTES = 28 << 20
#: Text bytes of a blob, if it has more than one text.
BLOB_BYTES = 256 << 10
#: Units whose masks are unfolded together.
MASK_ROWS = 50_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: What a byte of UTF-8 belongs to: a space, a letter, another character, or whatever the byte before it does.
_SPACE, _LETTER, _OTHER, _SAME = range(4)
_KIND = np.array([_SAME if 0x80 <= b < 0xC0 else _LETTER if chr(b).isascii() and chr(b).isalpha() or 0xC3 <= b < 0xC9 else
                  _SPACE if b == 32 else _OTHER for b in range(256)], np.uint8)
_BEYOND = re.compile(f"[^{SPACE}]{SPACE}|[{_LETTERS}][^{_LETTERS}]|[^{SPACE}{_LETTERS}][{_LETTERS}]")


class Vocabulary:
    """Pieces of a model file: normal pieces with scores, byte pieces, and their bytes for decoding."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.score, self.id_of, self.byte_id, self.raw = {}, {}, {}, []
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.raw.append(bytes([int(piece[3:5], 16)]))
                self.byte_id[self.raw[-1][0]] = i
            elif self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                self.score[piece], self.id_of[piece] = self.model.get_score(i), i
        beyond = [p for p in self.score if _BEYOND.search(p)]
        if beyond:
            raise ValueError(f"pieces go beyond a unit, so units would not be independent: {beyond[:5]}")
        self._raw = pa.array(self.raw, pa.binary())
        self._pieces = pa.array(list(self.id_of), pa.string())
        self._codes = _column(pa.binary(), np.arange(0, 4 * len(self.id_of) + 1, 4), np.array(list(self.id_of.values()), "<u4").view(np.uint8))

    def segment_ids(self, segment: str) -> list[int]:
        """Id of a piece; of an unknown character its bytes (or the unknown id)."""
        if segment in self.id_of:
            return [self.id_of[segment]]
        return [self.byte_id.get(b, self.model.unk_id()) for b in segment.encode()] if self.byte_id else [self.model.unk_id()]

    def unit_ids(self, unit: str, cuts: int | None) -> bytes:
        """Ids of a unit from the mask of its cuts; None: no piece of two characters lies in it."""
        if len(unit) > UNIT_CHARS:
            segments = self.merged(unit)
        elif cuts is None:
            segments = list(unit)
        else:
            at = [i for i in range(UNIT_CHARS + 1) if cuts >> i & 1]
            segments = [unit[x:y] for x, y in zip(at, at[1:])]
        return np.array([i for x in segments for i in self.segment_ids(x)], "<u4").tobytes()

    def codes(self, units: pa.Array, unit: pa.Array, cuts: pa.Array) -> pa.Array:
        """:meth:`unit_ids` of every one of ``units``, with the cuts of those that are a ``unit``."""
        chars = pc.utf8_length(units).to_numpy()
        # one bit per segment, at its first character; a long unit is one segment until it is merged
        first = np.where(chars > UNIT_CHARS, 1, (1 << np.minimum(chars, UNIT_CHARS).astype(np.int64)) - 1)
        place = pc.index_in(units, value_set=unit)
        first[np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))] &= cuts.take(place.drop_null()).to_numpy()
        done = [self._coded(units.slice(i, MASK_ROWS), first[i:i + MASK_ROWS]) for i in range(0, len(units), MASK_ROWS)]
        return pa.concat_arrays(done) if done else pa.array([], pa.binary())

    def _coded(self, units: pa.Array, first: np.ndarray) -> pa.Array:
        at, data = _bytes(units)
        row, char = np.nonzero(np.unpackbits(first.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool))
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        begin = starts[np.searchsorted(starts, at[:-1])[row] + char]
        segments = _column(pa.string(), np.append(begin, len(data)), data)
        place = pc.index_in(segments, value_set=self._pieces)
        codes = self._codes
        # a segment of over UNIT_CHARS characters is a long unit, even if a piece is written like it
        odd = pc.or_(pc.is_null(place), pc.greater(pc.utf8_length(segments), UNIT_CHARS))
        if pc.any(odd).as_py():
            rest = segments.filter(odd).dictionary_encode()
            codes = pa.concat_arrays([codes, pa.array([self.unit_ids(x, None) for x in rest.dictionary.to_pylist()], pa.binary())])
            place = pc.replace_with_mask(place, odd, pc.add(rest.indices, pa.scalar(len(self._pieces), pa.int32())))
        ends, ids = _bytes(codes.take(place))
        return _column(pa.binary(), ends[np.searchsorted(row, np.arange(len(units) + 1))], ids)

    def merged(self, unit: str) -> list[str]:
        """Segments of a unit after all merges, best score first and leftmost among equals."""
        text, after, before = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(text) and (whole := text[a] + text[b]) in self.score:
                heapq.heappush(heap, (-self.score[whole], a, whole))

        for a in range(len(text)):
            offer(a)
        while heap:
            _, a, whole = heapq.heappop(heap)
            b = after[a]
            if text[a] is None or b >= len(text) or text[a] + text[b] != whole:
                continue  # one of its halves has been merged with another
            text[a], text[b], after[a] = whole, None, after[b]
            if after[a] < len(text):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [x for x in text if x is not None]

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of rows of ids; bytes that are no UTF-8 become U+FFFD, the space put in front goes."""
        at, data = _bytes(ids)
        ends, text = _bytes(self._raw.take(pa.array(data.view("<u4"))))
        ends = ends[at // 4]
        spaced = np.zeros(len(ids), bool)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        spaced[full] = text[ends[full]] == 32
        out = _column(pa.binary(), ends - np.append(0, np.cumsum(spaced)), np.delete(text, ends[:-1][spaced]))
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a column of strings or binary values without nulls."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]


def _column(kind: pa.DataType, at: np.ndarray, data: np.ndarray) -> pa.Array:
    """The column of these offsets and bytes."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's copy of a model file (kept between tasks)."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts one after another, with plain spaces, and the offsets of the texts in them."""
    full = pc.greater(pc.binary_length(texts), 0)
    at, data = _bytes(pc.replace_substring(pc.if_else(full, pc.binary_join_element_wise(" ", texts, ""), texts), SPACE, " "))
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    if data.max() >= 0x80:
        for lead, odd, as_odd in ((0xC3, lambda x: (x == 0x97) | (x == 0xB7), _OTHER), (0xC9, lambda x: x < 0x90, _LETTER)):
            found = np.flatnonzero(data[:-1] == lead)
            kind[found[odd(data[found + 1])]] = as_odd
        for _ in range(3):
            found = np.flatnonzero(kind == _SAME)
            kind[found] = kind[found - 1]
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    begins[at[:-1][at[1:] > at[:-1]]] = True
    begins = np.flatnonzero(begins)
    return _column(pa.string(), np.append(begins, len(data)), data), np.searchsorted(begins, at)


def pack(batches):
    """Blobs of rows of ``(id, text)``, compressed, numbered within the task: at most BLOB_BYTES of text each or one text."""
    options, no = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)), 0
    for b in batches:
        size = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
        starts, held = [], BLOB_BYTES
        for i, n in enumerate(size.tolist()):
            if i == 0 or held + n > BLOB_BYTES:
                starts.append(i)
                held = 0
            held += n
        blobs = []
        for i, j in zip(starts, [*starts[1:], len(size)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                out.write_batch(b.slice(i, j - i))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(no, no + len(blobs)), pa.int64()), pa.array(blobs, pa.binary())], names=["no", "blob"])
        no += len(blobs)


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def piece_table(spark: SparkSession, scores: dict[str, float]) -> DataFrame:
    """``(piece, score, rank)``: rank 0 has the best score, equal scores have equal ranks."""
    rank = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
    return spark.createDataFrame([(p, x, rank[x]) for p, x in scores.items()], "piece string, score double, rank bigint")


def prefix_table(spark: SparkSession, scores: dict[str, float], chars: int) -> DataFrame:
    """``(prefix, longest)``: the first ``chars`` characters of the pieces that have so many, with the length of the longest such piece."""
    longest: dict[str, int] = {}
    for p in scores:
        if len(p) >= chars:
            longest[p[:chars]] = max(len(p), longest.get(p[:chars], 0))
    return spark.createDataFrame(list(longest.items()), "prefix string, longest int")


def _merge_fold(edges: str, n: str) -> str:
    """Mask of the places where the unit is cut after all merges; bit i is the place before character i.

    The sign bit marks that no edge fits any more, so the remaining steps are skipped.
    """
    fits = "(b & x.need) = x.need AND bit_count(b & x.mid) = 1"
    best = f"get(filter({edges}, x -> {fits}), 0).mid"
    return (f"aggregate(sequence(1, {n}), shiftleft(1L, {n}) - 1 + shiftleft(1L, {n}), "
            f"(b, i) -> IF(b < 0, b, coalesce(b & ~{best}, b | shiftleft(1L, 63)))) & 9223372036854775807L")


def _viterbi_fold(edges: str, n: str, unknown: float) -> str:
    """Places of the best path, as a mask: scores and best starts by position, then back from the end."""
    best = (f"array_max(array_append(transform(filter({edges}, x -> x.e = j), x -> struct(a[x.s].score + x.score AS score, x.s AS s)), "
            f"struct(a[j - 1].score + {unknown}D AS score, j - 1 AS s)))")
    forward = f"aggregate(sequence(1, {n}), array(struct(0D AS score, 0 AS s)), (a, j) -> array_append(a, {best}))"
    back = (f"aggregate(sequence(1, {n}), struct(shiftleft(1L, {n}) AS mask, {n} AS at), (c, i) -> IF(c.at = 0, c, "
            "struct(c.mask | shiftleft(1L, path[c.at].s) AS mask, path[c.at].s AS at))).mask")
    return f"element_at(transform(array({forward}), path -> {back}), 1)"


def unit_cuts(words: DataFrame, table: DataFrame, max_piece: int, fold: str = "merge", unknown: float = -100.0,
              prefixes: DataFrame | None = None) -> DataFrame:
    """``(unit, cuts long)`` for distinct ``words(unit)`` of at most UNIT_CHARS characters.

    Bit i of ``cuts`` is set if the segmentation cuts before character i (0 and
    the length included). With ``prefixes`` (:func:`prefix_table` of the least edge) a place
    where no piece starts is left out, and its substrings end where the longest piece does.
    """
    least = 1 if fold == "viterbi" else 2
    spots = words.withColumn("n", F.char_length("unit")).withColumn("s", F.explode(F.expr(f"sequence(0, greatest(n - {least}, 0))")))
    longest = str(max_piece)
    if prefixes is not None:
        spots = spots.withColumn("prefix", F.expr(f"substring(unit, s + 1, {least})")).join(F.broadcast(prefixes), "prefix")
        longest = "longest"
    spans = spots.withColumn("e", F.explode(F.expr(f"sequence(least(s + {least}, n), least(s + {longest}, n))"))) \
        .withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
    # the piece table is as large as the vocabulary, whatever the corpus
    matched = spans.join(F.broadcast(table), "piece")
    if fold == "viterbi":
        edge, folded = F.struct("e", "s", "score"), _viterbi_fold("edges", "n", unknown)
    else:
        # an edge is one number that sorts by rank, then start, so the lattices are grouped and sorted as plain numbers
        edge = F.expr("shiftleft(rank, 12) | shiftleft(s, 6) | e")
        masks = ("transform(edges, x -> struct(shiftleft(1L, cast(shiftright(x, 6) & 63 AS int)) | shiftleft(1L, cast(x & 63 AS int)) AS need, "
                 "shiftleft(1L, cast(x & 63 AS int)) - shiftleft(1L, cast(shiftright(x, 6) & 63 AS int) + 1) AS mid))")
        folded = f"element_at(transform(array({masks}), m -> {_merge_fold('m', 'n')}), 1)"
    lattice = matched.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return lattice.select("unit", F.expr(folded).alias("cuts"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_ids, ids binary, decoded string)`` per row: ids as little-endian unsigned 32-bit values.

    Ids equal the library's for BPE models; ``decoded`` is the text made from the
    ids again. Null and empty texts have no ids and decode to the empty text.
    Repeated rows and null ids are kept; extra columns are ignored.
    """
    spark = docs.sparkSession
    voc = vocabulary(path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(pack, "no bigint, blob binary") \
        .select(F.pmod(F.xxhash64("no", "blob"), F.lit(parts)).cast("int").alias("part"), "blob").repartition(tasks, "part")
    kind = dict(docs.dtypes)[id_col]

    def distinct_units(batches):
        held: dict[int, list[pa.Array]] = {}
        for b in batches:
            for p, blob in zip(b.column("part").to_pylist(), b.column("blob")):
                held.setdefault(p, []).append(units(unpack(blob.as_py()).column("text").combine_chunks())[0].unique())
            held = {p: [pa.concat_arrays(x).unique()] for p, x in held.items()}
        for p, (unit,) in held.items():
            unit = pc.replace_substring(unit.filter(pc.less_equal(pc.utf8_length(unit), UNIT_CHARS)), " ", SPACE)
            for i in range(0, len(unit), MASK_ROWS):
                some = unit.slice(i, MASK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p, np.int32)), some], names=["part", "unit"])

    # the filter is what the joins below would infer, each for its own use of the pairs, which would then be cut twice
    pairs = dealt.mapInArrow(distinct_units, "part int, unit string").where("unit is not null").repartition("unit")
    # the maximum keeps the part in both uses of the pairs, so one shuffle serves both
    distinct = pairs.groupBy("unit").agg(F.max("part").alias("any")).where("any >= 0").select("unit")
    cuts = unit_cuts(distinct, piece_table(spark, voc.score), max(map(len, voc.score)), prefixes=prefix_table(spark, voc.score, 2))
    needed = pairs.join(cuts, "unit").select("part", "unit", "cuts")

    def map_part(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocabulary(path)
        texts, found = [], []
        for blob in left.column("blob"):
            b = unpack(blob.as_py())
            unit, ends = units(b.column("text").combine_chunks())
            unit = unit.dictionary_encode()
            texts.append((b.column("id").combine_chunks(), ends, unit.indices))
            found.append(unit.dictionary)
        sizes = [len(x) for x in found]
        found = pa.concat_arrays(found).dictionary_encode()
        codes = v.codes(pc.replace_substring(found.dictionary, " ", SPACE), right.column("unit").combine_chunks(), right.column("cuts").combine_chunks())
        done, at = [], 0
        for (ids, ends, unit), size in zip(texts, sizes):
            starts, data = _bytes(codes.take(found.indices.slice(at, size).take(unit)))
            at += size
            coded = _column(pa.binary(), starts[ends], data)
            done.append(pa.RecordBatch.from_arrays([ids, pa.array(np.diff(starts[ends]) // 4, pa.int64()), coded, v.decode(coded)],
                                                   names=["id", "n_ids", "ids", "decoded"]))
        return pa.Table.from_batches(done)

    return dealt.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(
        lambda a, b: map_part(a, b), f"id {kind}, n_ids bigint, ids binary, decoded string").withColumnRenamed("id", id_col)

