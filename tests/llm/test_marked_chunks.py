"""Words with closing marks are encoded by parts; the memory keeps frequent chunks."""

import random

import numpy as np
import pytest

from quillon.llm import tokens
from quillon.llm.tokens import Encoder, vocabulary_path


class _Seen:
    def __init__(self, inner):
        self.inner, self.chars = inner, 0

    def encode_batch_fast(self, texts, **kw):
        self.chars += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marked_chunks_have_the_ids_of_the_whole(name, monkeypatch):
    enc, rnd = Encoder(vocabulary_path(name)), random.Random(5)
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 120)
    parts = ["ab", "Zebra", "d\u00e9j\u00e0", "\u00c5", "don't", "it's", "'", "12", "#", "***", "$$$", "_", "``", ".", "|", ">", "<", "\u03a3", "e\u0301", " ", "  ", "\n"]
    for _ in range(400):
        t = "".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(1, 40)))
        assert enc.encode(t) == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t
        assert len(enc.cache) <= 200 and len(enc.old) <= 200


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_words_with_new_marks_are_not_encoded_again(name):
    enc = Encoder(vocabulary_path(name))
    words = [f"{a}{b}somewhat" for a in "abcdefghij" for b in "klmnopqrst"]
    enc.encode("start " + " ".join(words))
    seen = enc.tokenizer = _Seen(enc.tokenizer)
    enc.encode("start " + " ".join(f"{w}***" for w in words))
    assert seen.chars < 100


def test_frequent_chunks_outlive_a_full_memory(monkeypatch):
    enc = Encoder(vocabulary_path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 400)
    frequent = " ".join(f"frequentword{a}" for a in "abcdefghij")
    seen = enc.tokenizer = _Seen(enc.tokenizer)
    enc.encode("x " + frequent)
    before = seen.chars
    for k in range(40):
        enc.encode("x " + " ".join(f"r{chr(97 + k % 26)}{chr(97 + k // 26)}{a}" for a in "abcdefghijklmnopqrst"))
        at = seen.chars
        enc.encode("x " + frequent)
        assert seen.chars == at
    assert before > 100
