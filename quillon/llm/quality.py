"""Quality rules: a linear-chain conditional random field labels each line of
a text as content or boilerplate; the share of content characters decides.

The field has two states, a weight vector per state over ``FEATURES`` line
features, and a transition matrix.  It is trained here by gradient ascent on
the log-likelihood (forward-backward) of a bounded sample of labelled
documents, of each at most ``TRAIN_LINES`` lines with a word, drawn by hash from the whole text: lines of good documents are content, lines of bad ones
boilerplate.  Decoding is Viterbi over all lines with a word, whole texts.

Defined cases: null or empty text has no words, fails the base rules and is
not kept; without labels of both classes the field is untrained and calls
every line content; equal rows get equal results.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile("[^ \t-\r]+")
_MARKED = re.compile(r"[#*$%&|<>!~^_=+{}\[\]\\@]")
SYMBOLS = "#*$%&|<>"
FEATURES = 10
#: Labelled documents that training reads at most, the length up to which it
#: takes a text, and the lines with a word that it reads from a text's start.
TRAIN_DOCS, TRAIN_LINES = 800, 40

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, content_share double")


def line_features(line: str, words: list[str], seen: bool) -> list[float]:
    n = len(words)
    return [1.0,
            min(n, 20) / 20,
            sum(map(str.isupper, words)) / n,
            len(_MARKED.findall(line)) / n,
            1 - len(set(words)) / n,
            sum(map(str.isdigit, words)) / n,
            float(line.rstrip()[-1:] in ".!?"),
            min(len(line) / n, 20) / 20,
            float(seen),
            float("|" in line or "!!" in line)]


def _lines(text: str):
    """(line, words) of the lines with a word, whether each is a repeat, and all words."""
    lines, seen, repeats, every = [], set(), [], []
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words:
            lines.append((line, words))
            repeats.append(line in seen)
            seen.add(line)
            every += words
    return lines, repeats, every


def repeated_words(words: list[str]) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    _, pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)
    _, back, count = np.unique(pair[:-1] * np.int64(len(ids)) + x[2:], return_inverse=True, return_counts=True)
    twice = count[back] > 1
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k:n - 2 + k] |= twice
    return int(cover.sum())


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best state sequence for line scores (n x 2) and a 2 x 2 transition matrix."""
    n = len(scores)
    back = np.zeros((n, 2), dtype=np.int8)
    (a, b), ((p, q), (r, s)) = scores[0].tolist(), trans.tolist()
    for k, (x, y) in enumerate(scores[1:].tolist(), 1):
        to_a, to_b = b + r > a + p, b + s > a + q
        back[k] = to_a, to_b
        a, b = x + (b + r if to_a else a + p), y + (b + s if to_b else a + q)
    path = np.empty(n, dtype=np.int8)
    path[-1] = b > a
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def _drawn_lines(batches):
    """Features of the drawn lines of each text, in the order of the text."""
    for pdf in batches:
        out = []
        for i, q, text in zip(pdf["doc_id"], pdf["quality"], pdf["text"]):
            lines, repeats, _ = _lines(text)
            if not lines:
                continue
            at = range(len(lines))
            if len(lines) > TRAIN_LINES:
                at = sorted(sorted(at, key=lambda k: (zlib.crc32(f"{k}:{lines[k][0]}".encode("utf-8", "replace")), k))[:TRAIN_LINES])
            out.append((i, q, [[float(v) for v in line_features(*lines[k], repeats[k])] for k in at]))
        yield pd.DataFrame(out, columns=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, docs_limit: int = TRAIN_DOCS, steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> dict:
    """Fit on the texts of at most ``docs_limit`` labelled documents, half of
    each class, picked by a hash of their id, one text of each (the smallest).
    An id that is labelled both ways trains both classes.  Tasks turn each text
    into the features of at most ``TRAIN_LINES`` of its lines, drawn by hash from
    the whole text, so no text reaches the driver.  Returns weights (2 x
    FEATURES; state 1 is boilerplate) and transitions, a few dozen numbers."""
    untrained = {"weights": [[0.0] * FEATURES] * 2, "trans": [[0.0, 0.0], [0.0, 0.0]]}
    pick = None
    for q in (0, 1):
        part = (labels.filter((F.col("quality") == q) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_limit // 2))
        pick = part if pick is None else pick.union(part)
    # At most docs_limit rows are broadcast, and as many come back.
    rows = (docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").filter(F.col("text").isNotNull())
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
            .mapInPandas(_drawn_lines, "doc_id long, quality int, x array<array<double>>").orderBy("doc_id", "quality").collect())
    seqs = [(np.array(r["x"]), 1 - r["quality"]) for r in rows]
    if len({y for _, y in seqs}) < 2:
        return untrained
    n, t = len(seqs), max(len(x) for x, _ in seqs)
    x, live = np.zeros((n, t, FEATURES)), np.zeros((n, t), dtype=bool)
    for k, (f, _) in enumerate(seqs):
        x[k, :len(f)], live[k, :len(f)] = f, True
    y = np.array([c for _, c in seqs])
    gold = np.zeros((n, t, 2))
    gold[np.arange(n), :, y] = live
    last, both = live.sum(1) - 1, live[:, 1:]
    w, a = np.zeros((2, FEATURES)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(a), np.zeros_like(w), np.zeros_like(a)]
    gold_trans = np.zeros((2, 2))
    np.add.at(gold_trans, (y, y), both.sum(1))
    for step in range(1, steps + 1):
        s = x @ w.T
        f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        f[:, 0] = s[:, 0]
        for k in range(1, t):
            f[:, k] = np.where(live[:, k, None], s[:, k] + np.logaddexp.reduce(f[:, k - 1, :, None] + a, axis=1), f[:, k - 1])
        for k in range(t - 2, -1, -1):
            b[:, k] = np.where(live[:, k + 1, None], np.logaddexp.reduce((s[:, k + 1] + b[:, k + 1])[:, None, :] + a, axis=2), 0)
        z = np.logaddexp.reduce(f[np.arange(n), last], axis=1)
        node = np.exp(np.where(live[..., None], f + b - z[:, None, None], -np.inf))
        edge = np.exp(np.where(both[..., None, None], f[:, :-1, :, None] + a + (s + b)[:, 1:, None, :] - z[:, None, None, None], -np.inf))
        grads = [np.einsum("ntc,ntf->cf", gold - node, x) / n - l2 * w, (gold_trans - edge.sum((0, 1))) / n - l2 * a]
        for k, (p, g) in enumerate(zip((w, a), grads)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * g * g
            p += rate * (moments[k] / (1 - 0.9 ** step)) / (np.sqrt(moments[k + 2] / (1 - 0.999 ** step)) + 1e-8)
    return {"weights": w.tolist(), "trans": a.tolist()}


def judge(text: str | None, weights: np.ndarray, trans: np.ndarray, min_share: float) -> tuple:
    text = text or ""
    lines, repeats, words = _lines(text)
    n, repeated = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    share = 0.0
    if lines:
        x = np.array([line_features(a, w, s) for (a, w), s in zip(lines, repeats)])
        size = np.array([len(a) for a, _ in lines])
        share = float(size[viterbi(x @ weights.T, trans) == 0].sum() / size.sum())
    return (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), sum(repeats), repeated,
            failed, not failed and share >= min_share, share)


def verdict(column, model: dict, min_share: float = 0.5):
    """Struct column of ``SCHEMA`` for a text column."""
    weights, trans = np.array(model["weights"]), np.array(model["trans"])

    @F.pandas_udf(SCHEMA)
    def rate(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame([judge(t, weights, trans, min_share) for t in texts], columns=names)

    return rate(column)


def rated(docs: DataFrame, model: dict, min_share: float = 0.5) -> DataFrame:
    """doc_id with the base counts and the verdict of every document."""
    return docs.select("doc_id", verdict(F.col("text"), model, min_share).alias("r")).select("doc_id", "r.*")


def kept_documents(docs: DataFrame, model: dict, min_share: float = 0.5) -> DataFrame:
    """The documents that pass, all columns unchanged."""
    return docs.filter(verdict(F.col("text"), model, min_share)["kept"])
