"""Tokenizer access inside tasks.

A text is cut where no token can cross: in front of each run of white space
(byte-level kind) or at white space (word kind, which drops it), and after a
run of plain letters that ends at a full stop or the like. Each distinct
chunk goes through the tokenizers library once per worker and its ids are kept
in a bounded table, so whole texts are encoded at dictionary speed with ids
equal to those of ``encode`` on the whole text (``tests/llm``). Texts are looked up
first and learned from on a miss only; plain new chunks go to the library joined by a separator.
"""

from __future__ import annotations

import os
import re
from itertools import batched, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

# Unicode White_Space, the set of the tokenizers' \s (Python's \s has four more control characters).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# (not U+0130, whose lower case ends in a mark that is no letter)
_LETTERS = r"A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ"
_STOPS = ".,;:!?"
_CHUNK = {
    "byte": re.compile(f"[{_WS}]*[{_LETTERS}]+(?=[{_STOPS}{_WS}])|[{_WS}]*[^{_WS}]+|[{_WS}]+"),
    "word": re.compile(f"[{_LETTERS}]+(?=[{_STOPS}{_WS}])|[^{_WS}]+"),
}
# What may stand between chunks that are learned together, and the chunks that may be: a line feed is a token of
# its own between a word and a blank or word; a control character is a word of its own between blanks.
_JOINT = {"byte": ("\n", re.compile(r" ?[!-~]+").fullmatch), "word": (" \x01 ", re.compile(r"[!-~]+").fullmatch)}
#: Chunks that are learned in one call, and that are joined to one text.
_LEARN = 4096
_JOINED = 64
#: Most chunks kept per worker; the later half goes beyond it (memory bound, not a result bound).
CACHE_CHUNKS = 700_000
#: Bytes of text that are learned from together.
_TOGETHER = 1 << 20
END_ID = 2


class ChunkEncoder:
    """Text to little-endian unsigned ids with a bounded chunk table."""

    def __init__(self, path: str, kind: str, id_bytes: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        if id_bytes == 2 and self._tok.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than 2 bytes an id")
        self._dtype = f"<u{id_bytes}"
        self._split = _CHUNK[kind].findall
        self._between, self._plain = _JOINT[kind]
        mark = self._tok.encode(self._between, add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        # a vocabulary of lower case: A-Z are folded first, which leaves fewer chunks to learn
        self._folds = self._tok.normalizer is not None and self._tok.normalizer.normalize_str("AZ") == "az"
        self._known: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        plain = [c for c in new if self._plain(c)] if self._mark is not None else []
        for groups in batched(batched(plain, _JOINED), _LEARN // _JOINED):
            for some, e in zip(groups, self._tok.encode_batch_fast([self._between.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self._dtype)
                cuts = np.flatnonzero(ids == self._mark)
                if len(cuts) != len(some) - 1:
                    raise ValueError("the separator of chunks is not a token of its own")
                raw, size = ids.tobytes(), ids.itemsize
                starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(raw)]
                self._known.update(zip(some, [raw[a:b] for a, b in zip(starts, ends)]))
        for some in batched(new.difference(plain), _LEARN):
            for c, e in zip(some, self._tok.encode_batch_fast(list(some), add_special_tokens=False)):
                self._known[c] = np.array(e.ids, self._dtype).tobytes()

    def encode_raw(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text."""
        split, out, missed, chars = self._split, [], [], 0
        for raw in texts:
            chunks = split((raw.lower() if self._folds else raw).decode("utf-8", "replace"))
            try:
                out.append(b"".join([self._known[c] for c in chunks]))
            except KeyError:
                missed.append((len(out), chunks))
                out.append(b"")
                chars += len(raw)
                if chars > _TOGETHER:
                    self._settle(missed, out)
                    missed, chars = [], 0
        self._settle(missed, out)
        return out

    def _settle(self, missed: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        """Learn the unknown chunks of the texts that missed, and encode these."""
        need = set().union(*[c for _, c in missed])
        new = need.difference(self._known)
        if len(self._known) + len(new) > CACHE_CHUNKS:
            # frequent chunks are met early: keep the earlier half
            self._known = dict(islice(self._known.items(), CACHE_CHUNKS // 2))
            new = need.difference(self._known)
        self._learn(new)
        known = self._known
        for at, chunks in missed:
            out[at] = b"".join([known[c] for c in chunks])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return self.encode_raw([t.encode("utf-8", "replace") for t in texts])

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[tuple[str, str, int], ChunkEncoder] = {}


def encoder(path: str, kind: str, id_bytes: int = 4) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file (kept between tasks)."""
    key = (path, kind, id_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def token_ids(docs: DataFrame, path: str, kind: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int | None = END_ID, id_bytes: int = 4) -> DataFrame:
    """``(id_col, n_ids long, ids binary)`` per row; ids as little-endian unsigned values of ``id_bytes`` (2 or 4).

    Null text counts as empty (the end id alone). Repeated rows stay repeated.
    """
    import pyarrow as pa

    end = b"" if end_id is None else np.array([end_id], f"<u{id_bytes}").tobytes()

    def run(batches):
        enc = encoder(path, kind, id_bytes).encode_raw
        for b in batches:
            ids = [x + end for x in enc(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // id_bytes for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[id_col, "n_ids", "ids"])

    kind_of = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), text_bytes(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind_of}, n_ids bigint, ids binary")
