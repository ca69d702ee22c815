"""Pairs of packed blocks of rows, for kernels that compare all rows with all rows.

A block is one row whose binary columns hold some thousand rows.  Both sides of
the product are read from stored blocks: a task holds one share of the right
side in memory and streams its left blocks past it, so blocks are never
replicated in a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stored

# Bytes of the right side that one task holds, and left blocks of one task.
SHARE_BYTES = 256 << 20
LEFT_BLOCKS = 8


def block_pairs(left: DataFrame, right: DataFrame | None = None, share_bytes: int | None = None) -> DataFrame:
    """All pairs of left and right blocks, columns prefixed ``a_`` and ``b_``, with
    the left block's number as ``a_no``.  The pairs of a left block with one share
    of the right side are consecutive rows of one task."""
    spark = left.sparkSession
    left = _numbered(left)
    right = left if right is None else _numbered(right)
    n, width = left.count(), _bytes(right)
    shares = max(1, math.ceil(width / (share_bytes or SHARE_BYTES)))
    parts = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism // shares, math.ceil(n / LEFT_BLOCKS))))
    side = lambda df, p, count: _spread(df, count).select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return side(left, "a", parts).hint("shuffle_replicate_nl").crossJoin(side(right, "b", shares))


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks as a stored table with numbers; a frame that has them is stored already."""
    return blocks if "no" in blocks.columns else stored(blocks.withColumn("no", F.monotonically_increasing_id()), "blocks")


def _bytes(blocks: DataFrame) -> int:
    binary = [F.col(c) for c, t in blocks.dtypes if t == "binary"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in binary), F.lit(0).cast("long"))
    return blocks.agg(F.sum(size)).first()[0] or 0


def _spread(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartition(parts) if parts > 1 else blocks.coalesce(1)
