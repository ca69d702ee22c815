"""Removal of repeated substrings by sorted, induced suffixes.

A byte goes if a ``SPAN``-byte string that covers it also starts elsewhere in
the corpus.  Sorting every suffix is out of reach of the disk budget (figures
in the README), so the suffixes are sampled by content and the rest induced:

1.  Sampling.  Of every ``WINDOW`` neighbouring ``GRAM``-byte strings the one
    with the smallest hash is kept (``GRAM + WINDOW - 1 = SPAN``), so equal
    ``SPAN``-byte strings hold equal samples at equal places.  Sampled
    strings that occur once are dropped.
2.  Sorting.  Sampled suffixes travel as tuples (sample, context, places)
    through Spark's external, disk-backed sort.  Within a sample they are
    ordered by their right context, and neighbours carry the length of their
    common prefix.
3.  Induction.  The suffixes that start a = 1, 2, ... bytes before a sample
    are ranked by (byte, rank of the suffix one byte on), the right context
    they still need being a cut of the common-prefix values.  Two starts are
    equal over ``SPAN`` bytes if both ranks agree: no hash decides here.

Equal texts are handled as one (all of them go), equal contexts of a text are
one tuple with several places, and tuples are handled in blocks of whole
samples.  A sample with more than ``HOT`` tuples does not go to one task: its
``SPAN``-byte strings become rows of their own, counted by an aggregate.

Defined cases: null text is empty; texts shorter than ``SPAN`` stay whole; rows
equal in doc_id and text remove each other like any copies; null ids are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import maybe_broadcast, row_key, slices, text_or_empty, written
from quillon.llm.shingles import _BYTE, mix

SPAN, WINDOW = 200, 128
GRAM = SPAN - WINDOW + 1
BLOCK_BYTES, BLOCK_ROWS, HOT = 1 << 18, 20_000, 50_000


def _grams(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-byte strings, by doubling."""
    total, done, out = GRAM, 0, None
    h, power, length = _BYTE[data], np.array([0x9E3779B97F4A7C15], dtype=np.uint64), 1
    n = len(data) - GRAM + 1
    # Parts of the length's binary digits, short ones first from the right end.
    parts = []
    while length <= total:
        if total & length:
            parts.append((h, power, length))
        h, power, length = h[:-length] * power + h[length:], power * power, length * 2
    for h, power, length in reversed(parts):
        part = h[done:done + n]
        out = part.copy() if out is None else out * power + part
        done += length
    return mix(out) | np.uint64(1)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i:i + width] for every i (width a power of two)."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _block_samples(pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    if len(data) < SPAN:
        return [(np.empty(0, np.int64), np.empty(0, np.uint64))] * len(pieces)
    h = _grams(data)
    least = _slide(h, WINDOW, np.minimum)
    starts = np.arange(len(least))
    least[starts + SPAN > ends[np.searchsorted(ends, starts, side="right")]] = 0
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum)[:len(h)]
    at = np.flatnonzero(most == h)
    cuts = np.searchsorted(at, ends)
    out, first = [], 0
    for k, last in enumerate(cuts):
        out.append((at[first:last] - (ends[k] - len(pieces[k])), h[at[first:last]]))
        first = last
    return out


def samples(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the sampled strings of each text."""
    found: list[list] = [[] for _ in texts]
    block, owner, room = [], [], BLOCK_BYTES

    def flush():
        for (k, offset), (at, h) in zip(owner, _block_samples(block)):
            found[k].append((at + offset, h))

    for k, t in enumerate(texts):
        for offset in range(0, max(1, len(t) - SPAN), BLOCK_BYTES):
            # Pieces of a long text overlap, so that every string lies in one.
            piece = t[offset:offset + BLOCK_BYTES + 2 * SPAN]
            block.append(piece)
            owner.append((k, offset))
            room -= len(piece)
            if room <= 0:
                flush()
                block, owner, room = [], [], BLOCK_BYTES
    if block:
        flush()
    out = []
    for parts in found:
        at = np.concatenate([a for a, _ in parts]) if parts else np.empty(0, np.int64)
        h = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.uint64)
        at, first = np.unique(at, return_index=True)
        out.append((at, h[first]))
    return out


def _contexts(batches):
    """Sampled suffixes with their contexts: (sample, context, left, key, places)."""
    for b in slices(batches, 200):
        cols: list[list] = [[], [], [], [], []]
        for key, text, at, h in zip(*(b.column(i).to_pylist() for i in range(4))):
            same: dict[tuple, list[int]] = {}
            for p, x in zip(at, h):
                left = min(p, WINDOW - 1)
                same.setdefault((x, left, text[p - left:p + SPAN]), []).append(p)
            for (x, left, context), places in same.items():
                for col, v in zip(cols, (x, context, left, key, places)):
                    col.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32())))],
                ["sample", "context", "left", "key", "places"])


def repeated_starts(sample: np.ndarray, contexts: list[bytes], left: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For whole samples: [tuple, a] is true if the SPAN bytes from ``a`` before
    the sampled string occur again among the tuples."""
    m = len(contexts)
    right = np.zeros((m, SPAN), dtype=np.uint8)
    before = np.zeros((m, WINDOW), dtype=np.uint8)
    for k, c in enumerate(contexts):
        raw = np.frombuffer(c, dtype=np.uint8)
        n = left[k]
        right[k, :len(raw) - n] = raw[n:]
        before[k, 1:n + 1] = raw[:n][::-1]
    length = np.array([len(c) for c in contexts]) - left
    order = np.lexsort((right.view(f"S{SPAN}").ravel(), sample))
    sorted_right, sorted_sample = right[order], sample[order]
    equal = sorted_right[1:] == sorted_right[:-1]
    common = np.where(equal.all(axis=1), SPAN, equal.argmin(axis=1))
    common[sorted_sample[1:] != sorted_sample[:-1]] = -1
    before, length, left, weight = before[order], length[order], left[order], weight[order]
    rank, again = np.zeros(m, dtype=np.int64), np.zeros((m, WINDOW), dtype=bool)
    for a in range(WINDOW):
        if a:
            rank = np.unique(rank * 256 + before[:, a], return_inverse=True)[1]
        cut = np.concatenate([[0], np.cumsum(common < SPAN - a)])
        live = (left >= a) & (length >= SPAN - a)
        if live.any():
            _, back = np.unique(cut[live] * m + rank[live], return_inverse=True)
            again[live, a] = np.bincount(back, weights=weight[live])[back] > 1
    out = np.empty_like(again)
    out[order] = again
    return out


def _induce(batches):
    """Runs of repeated starts (key, lo, hi) from tuples sorted by sample."""
    held: list = []

    def block(rows):
        sample = np.array([r[0] for r in rows], dtype=np.int64)
        weight = np.array([len(r[4]) for r in rows], dtype=np.int64)
        again = repeated_starts(sample, [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), weight)
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        keys, lo, hi = [], [], []
        for k, a, z in zip(row.tolist(), first.tolist(), (last - 1).tolist()):
            for p in rows[k][4]:
                keys.append(rows[k][3])
                lo.append(p - z)
                hi.append(p - a)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "lo", "hi"])

    for b in batches:
        held += zip(*(b.column(i).to_pylist() for i in range(5)))
        if len(held) >= BLOCK_ROWS:
            last = held[-1][0]
            whole = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] != last), -1) + 1
            if whole:
                yield block(held[:whole])
                held = held[whole:]
    if held:
        yield block(held)


def _spans_of_hot(batches):
    """Every SPAN-byte string of a hot sample's tuples: (digest, key, start)."""
    for b in slices(batches):
        out: list[list] = [[], [], []]
        for context, left, key, places in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
            for a in range(min(left, WINDOW - 1) + 1):
                s = left - a
                if s + SPAN <= len(context):
                    d = xxhash.xxh3_128_digest(context[s:s + SPAN])
                    for p in places:
                        for col, v in zip(out, (d, key, p - a)):
                            col.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32()))], ["digest", "key", "start"])


def _cut(batches):
    """(key, n_removed, n_spans, kept_sha256) from runs of repeated starts."""
    for b in slices(batches):
        rows = []
        for key, text, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4))):
            steps = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(steps, np.array(lo), 1)
            np.add.at(steps, np.array(hi) + SPAN, -1)
            gone = np.cumsum(steps[:-1]) > 0
            runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            rows.append((key, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             ["key", "n_removed", "n_spans", "kept_sha256"])


def repeated_substrings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    def scan(batches):
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            found = samples(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                 pa.array([at for at, _ in found], pa.list_(pa.int32())), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))],
                ["doc_id", "key", "n_bytes", "sha", "at", "h"])

    base = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    heads = written(base.select("doc_id", "key", F.col("text").cast("binary"))
                    .mapInArrow(scan, "doc_id long, key long, n_bytes long, sha string, at array<int>, h array<long>")
                    .withColumn("uid", F.monotonically_increasing_id()), "samples")
    one = heads.groupBy("sha").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n"))
    several = written(heads.select("sha", "uid").join(one.filter("n > 1"), "sha").select("uid", (F.col("uid") != F.col("first")).alias("copy")), "copies")
    copies = written(several.filter("copy").select("uid"), "copies")
    single = heads.join(maybe_broadcast(copies), "uid", "left_anti")
    each = single.select("key", F.explode(F.arrays_zip("at", "h")).alias("x")).select("key", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = written(each.join(often, "h").groupBy("key").agg(F.collect_list(F.struct("at", "h", (F.col("n") > hot).alias("hot"))).alias("x")), "marked")
    wanted = maybe_broadcast(written(marked.select("key"), "wanted"))
    texts = written(base.join(wanted, "key", "left_semi").select("key", F.col("text").cast("binary").alias("text")), "texts")

    def tuples(is_hot: bool) -> DataFrame:
        chosen = marked.withColumn("x", F.filter("x", lambda x: x["hot"] == is_hot)).filter(F.size("x") > 0)
        return (texts.join(chosen, "key").select("key", "text", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
                .mapInArrow(_contexts, "sample long, context binary, left int, key long, places array<int>"))

    runs = (tuples(False).repartition("sample").sortWithinPartitions("sample")
            .mapInArrow(_induce, "key long, lo int, hi int"))
    if not marked.filter(F.exists("x", lambda x: x["hot"])).isEmpty():
        spans = written(tuples(True).mapInArrow(_spans_of_hot, "digest binary, key long, start int").distinct(), "hot")
        again = spans.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
        runs = runs.union(spans.join(again, "digest").select("key", F.col("start").alias("lo"), F.col("start").alias("hi")))
    by_doc = runs.groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    cut = (texts.dropDuplicates(["key"]).join(by_doc, "key").select("key", "text", "lo", "hi")
           .mapInArrow(_cut, "key long, n_removed long, n_spans long, kept_sha256 string"))
    # Copies of a whole text go entirely if they hold a SPAN-byte string.
    full = (F.col("copy").isNotNull()) & (F.col("n_bytes") >= SPAN)
    pick = lambda whole, part, none: F.when(full, whole).otherwise(F.coalesce(part, none))
    return (heads.select("doc_id", "key", "uid", "n_bytes", "sha").join(several, "uid", "left").join(cut, "key", "left")
            .select("doc_id", "n_bytes",
                    pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
                    pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
                    pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256")))
