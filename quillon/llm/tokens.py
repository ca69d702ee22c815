"""Exact, cached use of a tokenizer file inside Python workers.

Byte-level and word BPE never merge across white space, so a text's ids are
the ids of its space-separated chunks in turn.  ``Encoder`` keeps the ids of
the chunks it has met and asks the library only for new ones.  Texts where
chunks could differ from the whole (special-token strings, white space
outside ASCII) and tokenizer files of other kinds are encoded whole.  New
chunks are encoded as one text, kept apart by a separator whose id occurs in
no chunk, so that the library makes one result for all of them.  A new chunk of
letters and closing marks (``word##``) is two pre-tokens for both kinds of files,
so its two parts are looked up and encoded instead.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Chunks that one worker remembers, in two generations: when the young one is full
# the old one is forgotten, so that frequent chunks stay.
CACHE_CHUNKS = 600_000

_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_BYTE = re.compile("[ ]?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WORD = re.compile("[^\t-\r ]+")
# Between chunks: white space for ``_BYTE``, a word of its own for ``_WORD``.
_BETWEEN = {_BYTE: "\n", _WORD: " \x00 "}
# Letters, then ASCII marks other than the apostrophe, which may begin a contraction.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_MARKED = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]+)")
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """``encode(text)``: ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks = self._chunks(path)
        self.between = _BETWEEN.get(self.chunks)
        self.cut = self._ids(self.between) if self.between else ()

    @staticmethod
    def _chunks(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if spec["model"]["type"] != "BPE":
            return None
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return _BYTE
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            return _WORD
        return None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _each(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk, of one call of the library where they can be told apart."""
        mark = self.between.strip(" ")
        if len(self.cut) == 1 and not any(mark in c for c in chunks):
            ids = self._ids(self.between.join(chunks))
            at = np.flatnonzero(ids == self.cut[0])
            if len(at) == len(chunks) - 1:
                data, cuts = ids.tobytes(), (4 * at).tolist()
                return [data[i:j] for i, j in zip([0, *[c + 4 for c in cuts]], [*cuts, len(data)])]
        return [self._whole(c) for c in chunks]

    def _learn(self, new: set[str]) -> None:
        """Put the ids of chunks into the young generation."""
        cache, old, marked, wanted = self.cache, self.old, [], set()
        for c in new:
            if (known := old.get(c)) is not None:
                cache[c] = known
            elif c[-1] in _MARKS and (m := _MARKED.fullmatch(c)):
                marked.append((c, *m.groups()))
            else:
                wanted.add(c)
        for part in {p for _, *parts in marked for p in parts if p not in cache}:
            if (known := old.get(part)) is not None:
                cache[part] = known
            else:
                wanted.add(part)
        # White space next to the separator would join it.
        plain = [c for c in wanted if not c.isspace()]
        if plain:
            cache.update(zip(plain, self._each(plain)))
        cache.update((c, self._whole(c)) for c in wanted if c.isspace())
        cache.update((c, cache[letters] + cache[marks]) for c, letters, marks in marked)

    def encode(self, text: str) -> bytes:
        if self.chunks is None or "<|" in text or _ODD.search(text):
            return self._whole(text)
        chunks = self.chunks.findall(text)
        ids = list(map(self.cache.get, chunks))
        new = {c for c, known in zip(chunks, ids) if known is None}
        if new:
            # A marked chunk is remembered with its parts.
            if len(self.cache) + 3 * len(new) > CACHE_CHUNKS // 2:
                self.cache, self.old = {}, self.cache
            self._learn(new)
            cache = self.cache
            ids = [cache[c] if known is None else known for c, known in zip(chunks, ids)]
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
