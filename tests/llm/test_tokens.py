"""The chunk tables of the tokenizer against the library on odd texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeworks.llm import tokens

PIECES = ["a", "B", "é", " ", "  ", "   ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", ".", "!", "?", "1", "12", "\xa0", "　", " ", "\x1c", "\x1f", "\0", "\x85",
          "日本", "don't", "'s", "_", "-", "😀", "ß", "İ", "́", "A.", "Z", "word,", "<|endoftext|>"]


@pytest.mark.parametrize("kind,name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
@pytest.mark.parametrize("cache", [500_000, 40])
def test_ids_equal_the_library_on_odd_texts(kind, name, cache, monkeypatch):
    """White space of all kinds and in all places, marks, controls and letters that grow in lower case; a table that overflows."""
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", cache)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "\n\n", "x\n\n", " ", "end of text. " * 50]
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    lib.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    enc = tokens.ChunkEncoder(public_tokenizers.path(name), kind)
    assert enc.encode_all(texts) == want
    assert enc.encode_all(texts[::-1]) == want[::-1]
