"""Exact quantiles by distributed selection.

The value of a rank is found by counting, not by sorting: values are counted in
equal ranges between bounds (a map-side aggregate of at most ``RANGES`` rows),
the range that holds the rank becomes the new bounds, and the counting repeats
until few rows are left between them or all of them are equal.  Only those rows
are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES, FEW = 1024, 10_000


def _value_at(values: DataFrame, rank: int, lo: float, hi: float, n: int) -> float:
    """The value with ``rank`` (from 0) among the ``n`` sorted values of [lo, hi]."""
    while lo < hi and n > FEW:
        inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        width = (hi - lo) / RANGES
        if width == 0.0 or lo + width == lo:
            break  # no double lies between the range bounds: the values left are few distinct ones
        per = (inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(RANGES - 1)).alias("r"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect())
        for row in per:  # at most RANGES rows
            if rank < row["n"]:
                lo, hi, n = row["lo"], row["hi"], row["n"]
                break
            rank -= row["n"]
    if lo == hi:
        return lo
    # Few rows, or few distinct values: counted by value.
    counts = values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
    for row in counts:
        if rank < row["n"]:
            return row["v"]
        rank -= row["n"]
    raise AssertionError("rank outside the counted values")


def exact_quantiles(df: DataFrame, column: str, fractions) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours; nulls, NaN and infinite
    entries are left out; None for each fraction if nothing is left."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.abs("v") < float("inf"))
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}

    def at(rank: int) -> float:
        if rank not in found:
            found[rank] = lo if rank == 0 else hi if rank == n - 1 else _value_at(values, rank, lo, hi, n)
        return found[rank]

    out = []
    for f in fractions:
        if not n:
            out.append(None)
            continue
        place = f * (n - 1)
        low = math.floor(place)
        out.append(at(low) + (place - low) * (at(min(low + 1, n - 1)) - at(low)) if place > low else at(low))
    return out
