"""Token counts with a shortcut for pre-tokens that are one token.

Before the job starts, ``prove`` asks the library itself which strings of the
vocabulary encode alone as exactly one token, and which class (letter, number,
white space, other) the library's pre-tokenizer gives to every character of
the basic plane.  Tasks cut texts by a pattern made of those classes, count
proven pre-tokens directly and let the library merge only the rest; counts of
the rest are remembered by each worker.

There is no shuffle: a task holds one text at a time, cut at places between
two letters where no pre-token can span, so a long text needs no long list.
The proof is broadcast; its size is bounded by the vocabulary.

Texts with a special token's string or characters outside the basic plane,
and tokenizer files of other kinds, are counted by the library as a whole.

Defined cases: null text is empty (0 bytes, 0 tokens); null ids stay; equal
rows are counted each; columns other than ``doc_id`` and ``text`` are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm.common import slices

# Rest pre-tokens that each of a worker's two memory generations holds, and
# the length up to which they are remembered.
REMEMBERED, LONGEST = 300_000, 64
# Characters after which a text is cut at the next safe place.
SEGMENT = 1 << 16

# The contractions of the byte-level pre-tokenizer.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_SAFE_CUT = re.compile("[A-Za-z](?= [A-Za-z])")
_COUNTERS: dict[str, "Counter"] = {}


@dataclass(frozen=True)
class Proof:
    """What is known of a tokenizer file before any text is read.

    ``pattern`` is None for files without a proven cut; ``odd`` finds texts
    that must be encoded whole; ``whole`` holds the one-token strings."""
    pattern: str | None
    odd: str | None
    whole: frozenset


def library(path: str):
    """``text -> number of tokens`` by the file's own library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _ranges(points: list[int]) -> str:
    """A character class body for sorted code points."""
    a = np.array(points)
    starts = np.flatnonzero(np.diff(a, prepend=-2) != 1)
    ends = np.append(starts[1:], len(a)) - 1
    return "".join(f"\\u{a[s]:04x}-\\u{a[e]:04x}" for s, e in zip(starts, ends))


def _byte_level(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex"))
            and not pre.get("add_prefix_space") and not model.get("dropout"))


def _byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def prove(path: str) -> Proof:
    """Classes and one-token strings, each confirmed by the library."""
    if path.endswith(".model"):
        return Proof(None, None, frozenset())
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _byte_level(spec):
        return Proof(None, None, frozenset())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    kinds: dict[str, list[int]] = {"a": [], "0": [], "!": [], "\n": []}
    unknown = []
    for c in (*range(0xD800), *range(0xE000, 0x10000)):
        # A character is of the class whose member it is not parted from.
        kind = next((k for k in kinds if len(cut(k + chr(c))) == 1), None)
        (unknown if kind is None else kinds[kind]).append(c)
    letter, number, other, space = map(_ranges, kinds.values())
    pattern = "|".join([*CONTRACTIONS, f" ?[{letter}]+", f" ?[{number}]+", f" ?[{other}]+", f"[{space}]+(?![^{space}])", f"[{space}]+"])
    odd = "|".join([*(re.escape(t["content"]) for t in spec.get("added_tokens", [])), f"[\\U00010000-\\U0010ffff{_ranges(unknown) if unknown else ''}]"])

    find, symbol = re.compile(pattern).findall, _byte_of_symbol()
    strings, ids = [], []
    for token, k in spec["model"]["vocab"].items():
        try:
            s = bytes(map(symbol.__getitem__, token)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        strings.append(s)
        ids.append(k)
    odd_text = re.compile(odd).search
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    whole = frozenset(s for s, k, e in zip(strings, ids, encoded) if e.ids == [k] and find(s) == [s] and not odd_text(s))
    return Proof(pattern, odd, whole)


class Counter:
    """``count(text)``: tokens, and pre-tokens counted without the library."""

    def __init__(self, path: str, proof: Proof):
        self.library, self.whole = library(path), proof.whole
        self.find = re.compile(proof.pattern).findall if proof.pattern else None
        self.odd = re.compile(proof.odd).search if proof.odd else None
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        if self.find is None or self.odd(text):
            return self.library([text])[0], 0
        tokens = direct = 0
        for part in segments(text):
            found, whole = self.find(part), self.whole
            rest = [t for t in found if t not in whole]
            direct += len(found) - len(rest)
            tokens += self._rest(rest)
        return tokens + direct, direct

    def _rest(self, rest: list[str]) -> int:
        young, old = self.young, self.old
        new, total = {}, 0
        for t in rest:
            n = young.get(t)
            if n is None:
                n = old.get(t)
                if n is None:
                    new[t] = new.get(t, 0) + 1
                    continue
                young[t] = n
            total += n
        if new:
            for (t, times), n in zip(new.items(), self.library(list(new))):
                total += n * times
                if len(t) <= LONGEST:
                    young[t] = n
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return total


def segments(text: str):
    """The text in parts, cut between a letter and " letter" only."""
    at = 0
    while len(text) - at > 2 * SEGMENT:
        m = _SAFE_CUT.search(text, at + SEGMENT)
        if m is None:
            break
        yield text[at:m.end()]
        at = m.end()
    yield text[at:]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and
    n_direct (pre-tokens that the proof counted)."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(tokenizer))

    def count(batches):
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(tokenizer, proof.value)
        counter = _COUNTERS[tokenizer]
        for b in slices(batches):
            text = pc.fill_null(b.column(1), "")
            both = [counter.count(t) for t in text.to_pylist()]
            tokens = pa.array([n for n, _ in both], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pc.cast(pc.binary_length(text), pa.int64()), tokens, pc.greater(tokens, limit),
                 pa.array([n for _, n in both], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"])

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_direct long")
