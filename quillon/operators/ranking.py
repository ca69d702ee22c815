"""Ranking, split and top-K operators.

Per-subject ranks are computed without one window over a subject's whole
history: rows are first counted per (subject, date) -- a window over at
most the number of distinct dates of a subject, bounded by the calendar --
and only ties inside one (subject, date) are ranked row by row.  A subject
holding a third of all rows is therefore spread over its dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.session import bounded_broadcast, cut_lineage, stored

# Ranks counted together in ``top_k_excluding``.
RANK_BUCKET = 1024


def recency_rank(history: DataFrame, subject: str = "subject_id", date: str = "last_date",
                 item: str = "item_id", out: str = "recency", size: str | None = None) -> DataFrame:
    """0 for the newest row of a subject, ties on date broken by item desc.

    Equals ``row_number() over (partition by subject order by date desc, item desc) - 1``.
    ``size`` names a column for the number of the subject's rows, which the days add up to.
    """
    per_day = history.groupBy(subject, date).agg(F.count(F.lit(1)).alias("_n_day"))
    w_days = (Window.partitionBy(subject).orderBy(F.col(date).desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    newer = per_day.withColumn("_newer", F.coalesce(F.sum("_n_day").over(w_days), F.lit(0)))
    if size:
        newer = newer.withColumn(size, F.sum("_n_day").over(Window.partitionBy(subject)))
    w_in_day = Window.partitionBy(subject, date).orderBy(F.col(item).desc())
    return (history.join(newer.select(subject, date, "_newer", *([size] if size else [])), [subject, date])
            .withColumn(out, (F.col("_newer") + F.row_number().over(w_in_day) - 1).cast("int"))
            .drop("_newer"))


def leave_last_n_out(history: DataFrame, n: int, subject: str = "subject_id",
                     date: str = "last_date", item: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hide each eligible subject's ``n`` newest items.

    Eligible = more than ``n`` items.  Returns (eligible subjects, known rows,
    hidden rows); known and hidden are restricted to eligible subjects.
    """
    sizes = history.groupBy(subject).agg(F.count(F.lit(1)).alias("n_items"))
    eligible = sizes.filter(F.col("n_items") > n).select(subject, "n_items")
    # Both sides of the split are read by several jobs.
    r = recency_rank(history, subject, date, item, size="_size").filter(F.col("_size") > n).drop("_size")
    r = stored(r, "split")
    hidden = r.filter(F.col("recency") < n)
    known = r.filter(F.col("recency") >= n)
    return eligible, known, hidden


def hash_sample(subjects: DataFrame, fraction: float, seed: int = 42,
                subject: str = "subject_id") -> DataFrame:
    """D3: keep the first int(n * fraction) subjects in the order of md5("seed:subject").

    Stable under repartitioning.  The cut is a scalar subquery; the order is
    a global sort (range partitioned), not a single-task window.
    """
    n_keep = subjects.agg(F.floor(F.count(F.lit(1)) * F.lit(float(fraction))).cast("long")).scalar()
    h = subjects.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(subject))))
    ranked = global_rank(h, [F.col("_h").asc(), F.col(subject).asc()], "_rk")
    return ranked.filter(F.col("_rk") <= n_keep).drop("_h", "_rk")


def global_rank(df: DataFrame, order, out: str = "rank", checkpoint: bool = True) -> DataFrame:
    """Consecutive 1-based rank over a total order without a single-partition window.

    A range-partitioned sort, then per-partition row counts (one row per
    partition) turned into offsets.  The result is checkpointed so the
    partition-dependent ids are fixed before reuse and survive executor loss.
    """
    s = (df.orderBy(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # <= #partitions rows
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (s.join(F.broadcast(offs.select("_pid", "_off", "_first")), "_pid")
            .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_pid", "_mid", "_off", "_first"))


def top_k(df: DataFrame, k: int, score: str = "score", subject: str = "subject_id",
          item: str = "item_id", out: str = "rank", digits: int | None = 9) -> DataFrame:
    """Best k rows per subject by (score desc, item asc), rank 1..k.

    Scores are compared after rounding to ``digits`` so that sums taken in a
    different order (partitioning) cannot reorder true ties.

    ``row_number() <= k`` is planned as a WindowGroupLimit whose partial
    step runs before the shuffle, so a hot subject is cut to k rows per
    map partition.
    """
    key = F.round(F.col(score), digits) if digits is not None else F.col(score)
    w = Window.partitionBy(subject).orderBy(key.desc(), F.col(item).asc())
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def top_k_excluding(ranked_items: DataFrame, subjects: DataFrame, exclude: DataFrame, k: int,
                    subject: str = "subject_id", item: str = "item_id",
                    rank_col: str = "rank") -> DataFrame:
    """Per subject, the first k items of a globally ranked list that are
    not in the subject's exclusion set.

    Exact by counting, k rows per subject whatever it excludes: the i-th
    excluded rank r of a subject has ``r - i`` free ranks before it, so the
    j-th free rank is ``j + #(excluded with r - i < j)``.  The place i is a
    prefix count over rank buckets plus a row number inside one bucket, so no
    window holds more than ``RANK_BUCKET`` rows or the number of buckets.
    Repeated exclusions count once; excluded items outside the list change
    nothing; a list that runs out gives fewer than k rows.
    """
    # A subject with e excluded items asks for ranks up to k + e, and only excluded
    # ranks up to there move them, so the list is read no further than the largest e.
    most = exclude.groupBy(subject).agg(F.count(F.lit(1)).alias("e")).agg(F.max("e")).first()[0] or 0
    # Every subject asks for a rank near 1..k; a list of checked size is
    # broadcast, so that those ranks are no hot join keys.
    near = bounded_broadcast(ranked_items.filter(F.col(rank_col) <= k + most))
    held = exclude.select(subject, item).join(near.select(item, F.col(rank_col).alias("_r")), item).select(subject, "_r").distinct()
    slots = free_places(held, subjects.select(subject), k, [subject], "_r").withColumnRenamed("_r", rank_col)
    return slots.join(near, rank_col)


def free_places(held: DataFrame, runs: DataFrame, k: int, by: list, place: str) -> DataFrame:
    """Per run (``by`` columns), its first ``k`` places 1, 2, ... that ``held``
    (``by`` and distinct places) does not name; other columns of ``runs`` stay.

    The counting of ``top_k_excluding``."""
    held = held.select(*by, F.col(place).alias("_r"), F.floor(F.col(place) / RANK_BUCKET).alias("_b"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = (held.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
              .select(*by, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_r"))
    free = held.join(before, [*by, "_b"]).select(*by, (F.col("_r") - nth).alias("_free"))
    steps = (free.filter(F.col("_free") < k).groupBy(*by)
             .agg(F.array(*[F.count_if(F.col("_free") < j) + j for j in range(1, k + 1)]).alias("_at")))
    untouched = F.array(*[F.lit(j).cast("long") for j in range(1, k + 1)])
    return runs.join(steps, by, "left").select(*runs.columns, F.explode(F.coalesce("_at", untouched)).alias(place))


def prefix_sums(df: DataFrame, order, cols, checkpoint: bool = True) -> DataFrame:
    """Inclusive running sums of ``cols`` along a total order, as ``cum_<col>``.

    Range-partitioned sort; each partition's totals (one row per partition)
    become offsets; running sums inside a partition are computed batch by
    batch in ``mapInPandas`` (per-partition sequential logic, partition order
    preserved).  Checkpointed so the partition layout is fixed.
    """
    from pyspark.sql.types import StructField, LongType, DoubleType, StructType

    s = df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
    if checkpoint:
        s = cut_lineage(s)
    tot = s.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # <= #partitions rows
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in cols])
    types = {f.name: f.dataType for f in s.schema.fields}
    out_fields = list(s.schema.fields) + [
        StructField(f"_run_{c}", DoubleType() if isinstance(types[c], DoubleType) else LongType()) for c in cols]

    def run(it):
        carry = {c: 0 for c in cols}
        for pdf in it:
            for c in cols:
                cs = pdf[c].fillna(0).cumsum() + carry[c]
                if len(cs):
                    carry[c] = cs.iloc[-1]
                pdf[f"_run_{c}"] = cs
            yield pdf

    r = s.mapInPandas(run, StructType(out_fields))
    r = r.join(F.broadcast(offs), "_pid")
    for c in cols:
        r = r.withColumn(f"cum_{c}", F.col(f"_run_{c}") + F.col(f"_o_{c}")).drop(f"_run_{c}", f"_o_{c}")
    return r.drop("_pid")
