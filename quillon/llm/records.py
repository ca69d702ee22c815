"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames, one for each document, in ascending order of
(doc_id, text hash), nulls first:

    length    u64  bytes of the payload
    mask      u32  masked checksum of the eight length bytes
    payload        i64 doc_id, u8 null flag, then the ids (u16 if the
                   vocabulary fits, else u32; the width is a payload byte too)
    mask      u32  masked checksum of the payload
    0x0A           end of frame

All numbers are little-endian.  The checksum is CRC-32, masked by rotating
right 15 bits and adding a constant, so that checksums of data which itself
holds checksums stay sound.  Files are written through Spark's own text
writer (rows of raw bytes, one line end after each), hence with its commit
protocol on any file system Spark can reach; a lost executor leaves no part
file behind.  The index (Parquet: file, offset, length, doc_id, start,
n_tokens, ids_crc32) lets a reader fetch frames in any order.

Defined cases: null text counts as empty (one end id); null ids sort first;
equal rows get a record each; an empty table gives an index without rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import shuffle_partitions, slices
from quillon.llm.tokens import encoder
from quillon.session import checkpoint_dir

_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qBB")
_CRC = struct.Struct("<I")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its closing line end."""
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    payload = _META.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + _CRC.pack(masked(size)) + payload + _CRC.pack(masked(payload))


def frames(data: bytes):
    """``(offset, length, doc_id, ids)`` of each frame; raises on damage."""
    at, view = 0, memoryview(data)
    while at < len(data):
        size, check = _HEAD.unpack_from(data, at)
        payload = view[at + 12:at + 12 + size]
        if masked(data[at:at + 8]) != check or len(payload) < size \
                or _CRC.unpack_from(data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, null, width = _META.unpack_from(payload)
        yield at, size + 17, None if null else doc_id, np.frombuffer(payload[_META.size:], dtype=f"<u{width}")
        at += size + 17


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, files: int | None = None) -> None:
    """Tokenize every text and write the data files under ``path``/data."""
    def encode(batches):
        enc = encoder(tokenizer)
        for b in slices(batches):
            out = [frame(i, np.append(np.frombuffer(enc.encode(t or ""), dtype="<u4"), end_id))
                   for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    tie = F.xxhash64("text")
    (docs.select("doc_id", "text")
     .repartitionByRange(files or shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
     .mapInArrow(encode, "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.text(f"{path}/data", lineSep="\n"))


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the data files back, check every frame, write and return the index."""
    def scan(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                start, rows = 0, []
                for offset, length, doc_id, ids in frames(data.as_py()):
                    rows.append((name, offset, length, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX)], _NAMES)

    rows = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
            .mapInArrow(scan, "file string, offset long, length long, doc_id long, in_file long, n_tokens long, ids_crc32 long"))
    rows.write.parquet(f"{path}/frames")
    rows = spark.read.parquet(f"{path}/frames")
    # One row per file: part names sort in the order of their doc_id ranges.
    first = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    first = first.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    (rows.join(first, "file").withColumn("start", F.col("before") + F.col("in_file"))
     .select("file", "offset", "length", "doc_id", "start", "n_tokens", "ids_crc32")
     .write.parquet(f"{path}/index"))
    return spark.read.parquet(f"{path}/index")


_INDEX = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["file", "offset", "length", "doc_id", "in_file", "n_tokens", "ids_crc32"]


def write_and_index(docs: DataFrame, tokenizer: str, path: str | None = None, **params) -> DataFrame:
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, path, tokenizer, **params)
    return build_index(spark, path)


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """``(doc_id, ids)`` in a seeded random order: every file's frames are cut
    at the index's offsets, then sorted by a hash of their place."""
    def cut(key, index, files):
        import pandas as pd

        data = files["content"].iloc[0]
        got = [next(frames(data[o:o + n])) for o, n in zip(index["offset"], index["length"])]
        return pd.DataFrame({"file": key[0], "offset": index["offset"],
                             "doc_id": pd.array([g[2] for g in got], dtype="Int64"),
                             "ids": [g[3].astype("int64") for g in got]})

    index = spark.read.parquet(f"{path}/index").select("file", "offset", "length")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    return (index.groupBy("file").cogroup(files.groupBy("file"))
            .applyInPandas(cut, "file string, offset long, doc_id long, ids array<long>")
            .orderBy(F.xxhash64(F.lit(seed), "file", "offset")).select("doc_id", "ids"))
