"""Word-shingle sets of whole texts as sorted 64-bit hashes, vectorised."""

from __future__ import annotations

import numpy as np

# Texts are hashed together up to so many bytes.
BLOCK_BYTES = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Odd multipliers for places 0..n-1 in a word."""
    global _PLACE
    while len(_PLACE) < n:
        _PLACE = np.concatenate([_PLACE, mix(_PLACE) | np.uint64(1)])
    return _PLACE


def _block(texts: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, doc_ends)
    if not len(starts):
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    lengths = ends - starts
    place = np.arange(len(data))
    place[:starts[0]] = 0
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(word, _BYTE[data] * _powers(int(place.max()) + 1)[place], np.uint64(0))
    words = mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    place = _powers(size + 4)
    grams = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        grams += words[k:len(words) - size + 1 + k] * place[k]
    grams = mix(grams)
    out, first = [], 0
    for last in bounds:
        n = last - first
        if n >= size:
            out.append(np.unique(grams[first:last - size + 1]))
        elif n:
            # The place behind the words marks how many there are.
            short = (words[first:last] * place[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + place[size:size + 1] * np.uint64(n)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        first = last
    return out


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each UTF-8 text,
    A-Z lower-cased; a shorter text is one shingle, one without words none."""
    out, block, room = [], [], BLOCK_BYTES
    for t in texts:
        t = (t or b"").lower()  # bytes: A-Z only
        block.append(t)
        room -= len(t)
        if room <= 0:
            out += _block(block, size)
            block, room = [], BLOCK_BYTES
    return out + (_block(block, size) if block else [])
