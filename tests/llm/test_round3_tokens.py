"""Findings of round 3 on the tokenizing operators, on texts made here."""
import random

import numpy as np
import pytest

from quillon.llm.tokens import Encoder, vocabulary_path


class _Counted:
    """A tokenizer that counts the texts that it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_chunks_are_encoded_as_one_text(name):
    """Ids are those of the whole text, whatever the chunks hold, and the library
    makes one result for all new words of a text."""
    enc, rnd = Encoder(vocabulary_path(name)), random.Random(3)
    parts = ["ab", "Zebra", "d\u00e9j\u00e0", "\u4f60\u597d", "e\u0301", "\u0301x", "\u03a3\u03a3", "don't", "'s", "1234", "#!", "\x00", "a\x00b", "\x01", "\U0001f600",
             " ", "  ", "\n", "\t", "\r\n", " \n ", "|>", "<", "end"]
    texts = ["", " ", "\n", "\x00", "a \x00 b", "<|endoftext|>", "\u00a0a b"]
    texts += ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for t in texts:
        want = np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert enc.encode(t) == want, t
        assert enc.encode(t) == want, t
    counted = enc.tokenizer = _Counted(enc.tokenizer)
    enc.encode(" ".join(f"word{i}q" for i in range(1000)))
    assert counted.texts <= 2
