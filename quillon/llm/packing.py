"""Best-fit packing by minimum bin slack.

Texts become token ids with an end id; a document longer than a sequence is
cut into full pieces and a rest.  Each bin is opened with the longest piece
left, and a subset-sum over the other lengths, held as the bits of one
integer, finds the fullest feasible combination, which is then removed.
Pieces are dealt by hash into groups of about ``GROUP_BINS`` sequences that
Spark packs independently; pieces in bins that did not fill up go through a
second round together, so the waste is a few bins over the whole corpus.

Defined cases: null text is empty (one end id); null ids are packed like
others; equal rows give separate pieces; an empty table packs to nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, written
from quillon.llm.tokens import encoder

GROUP_BINS = 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def cut(batches):
        enc = encoder(tokenizer)
        for b in slices(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.encode(t or "") + end
                for k in range(0, len(raw), step):
                    part = raw[k:k + step]
                    rows.append((i, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset for each length."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left: dict[int, list[int]] = {}
    for k in np.argsort(lengths, kind="stable")[::-1]:
        left.setdefault(int(lengths[k]), []).append(int(k))
    order, n = list(left), 0  # longest first
    while order:
        chosen = [order[0]]
        room = capacity - order[0]
        if room > 0:
            sums, steps, mask = 1, [], (1 << (room + 1)) - 1
            for size in order:
                if size > room:
                    continue
                for _ in range(min(len(left[size]) - (size == chosen[0]), room // size)):
                    wider = (sums | sums << size) & mask
                    if wider == sums:
                        break
                    steps.append((size, sums))
                    sums = wider
                if sums >> room:
                    break
            best = sums.bit_length() - 1
            for size, before in reversed(steps):
                if not before >> best & 1:
                    chosen.append(size)
                    best -= size
        at = 0
        for size in chosen:
            k = left[size].pop()
            bins[k], offsets[k], at = n, at, at + size
        order = [s for s in order if left[s]] if any(not left[s] for s in chosen) else order
        n += 1
    return bins, offsets


def _round(rows: DataFrame, capacity: int, number: int, final: bool) -> DataFrame:
    groups = int(rows.agg(F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / (capacity * GROUP_BINS))).first()[0] or 0)

    def pack(pdf):
        length = pdf["length"].to_numpy()
        bins, offsets = minimum_bin_slack(length, capacity)
        fill = np.bincount(bins, weights=length)
        closed = np.ones(len(pdf), dtype=bool) if final else fill[bins] == capacity
        return pdf.assign(sequence_id=(number << 60) + (pdf["part"].to_numpy().astype(np.int64) << 20) + bins,
                          offset=offsets, closed=closed).drop(columns="part")

    schema = "uid long, length long, sequence_id long, offset long, closed boolean"
    return (rows.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(max(1, groups))).alias("part"))
            .groupBy("part").applyInPandas(pack, schema))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and place in it."""
    cut = written(pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    first = written(_round(cut.select("uid", "length"), capacity, 0, False), "bins")
    second = _round(first.filter("not closed").select("uid", "length"), capacity, 1, True)
    placed = first.filter("closed").union(second).drop("length", "closed")
    return cut.join(placed, "uid").drop("uid")
