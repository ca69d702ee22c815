"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, followed by
the same queue again for a second pass.  A document's virtual finish time is
the source's cumulative words, itself included, divided by the source's
weight.  All entries are range-sorted by finish time and the mix is the
prefix whose words fit the budget.  A source that runs out of entries leaves
its share to the others by weight, which is what the closed form of the
targets computes.

Hot sources: the cumulative sums are taken in two levels (hash ranges inside
a source, then rows inside a range), the global ones in two levels as well
(ranges of finish time), so no task holds a whole source.

Defined cases: null or empty text has size 0, is never queued and is taken 0
times; a null source is a source of its own, ranked last; null ids queue like
others; equal rows are separate entries; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, row_key, written

# Rows that one range of the two-level sums aims at.
RANGE_ROWS = 20_000


def word_count(c):
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float, weights: tuple, repeats: int) -> DataFrame:
    """One row per source: rank, weight, size, cap, target and the water level
    (virtual time at which the budget is used up)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("max_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_fill = Window.orderBy("fill", "rank")
    return (per
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
            .withColumn("weight", w.cast("double"))
            .withColumn("cap", F.col("source_size") * F.lit(repeats))
            .withColumn("fill", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
            .withColumn("below", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("v", (F.col("budget") - F.col("below")) / F.col("left"))
            .withColumn("level", F.coalesce(F.max(F.when(F.col("v") <= F.col("fill"), F.col("v"))).over(every),
                                            F.max("fill").over(every)))
            .withColumn("horizon", F.col("level") + F.max(F.col("max_size") / F.col("weight")).over(every))
            .withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
            .drop("below", "left", "v", "fill"))


def _range_of(key, n: int):
    """Range 0..n-1 of a hex digest by its first four digits (n <= 65536)."""
    return F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("long") * n / 65536)


def fair_mix(docs: DataFrame, share: float = 1.5, weights: tuple = (5, 2, 1), repeats: int = 2,
             seed: str = "mix") -> DataFrame:
    """One row per document: ``key`` (row identity), ``doc_id``, ``source``,
    ``size``, ``source_size``, ``target``, ``copies`` (times taken) and
    ``finish`` (virtual finish time of its first taken copy, else null)."""
    sized = written(docs.select("doc_id", "source", row_key("doc_id", "source", "text").alias("key"),
                                word_count(F.col("text")).alias("size")), "sized")
    n = int(min(65536, max(16, sized.count() // RANGE_ROWS)))
    src = written(source_targets(sized, share, weights, repeats), "sources")
    rows = (sized.join(src.select(F.col("source").alias("s"), "rank", "weight", "source_size", "target", "horizon", "level", "budget"),
                       F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    queued = (rows.filter("size > 0")
              .withColumn("u", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"))))
              .withColumn("part", _range_of(F.col("u"), n)))
    before = (queued.groupBy("rank", "part").agg(F.sum("size").alias("words"))
              .select("rank", "part", (F.sum("words").over(Window.partitionBy("rank").orderBy("part")) - F.col("words")).alias("before")))
    in_part = Window.partitionBy("rank", "part").orderBy("u", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    queue = written(queued.join(before, ["rank", "part"])
                    .withColumn("cum", F.col("before") + F.sum("size").over(in_part)).drop("before", "part"), "queue")
    # Entries past the horizon cannot fit: by then all that is due at the
    # water level has finished, and that alone uses up the budget.
    entries = (queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
               .withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("cum")) / F.col("weight"))
               .filter("finish <= horizon")
               .withColumn("slot", F.floor(F.col("finish") * n / F.col("level"))))
    slots = entries.groupBy("slot").agg(F.sum("size").alias("words"))
    slots = slots.select("slot", (F.sum("words").over(Window.orderBy("slot")) - F.col("words")).alias("before"))
    in_slot = Window.partitionBy("slot").orderBy("finish", "rank", "turn", "cum").rowsBetween(Window.unboundedPreceding, 0)
    taken = (entries.join(slots, "slot")
             .withColumn("total", F.col("before") + F.sum("size").over(in_slot))
             .filter("total <= budget"))
    keep = ["rank", "cum", "key", "doc_id", "source", "size", "source_size", "target"]
    none = F.lit(None).cast("double").alias("finish")
    counted = (taken.select(*keep, F.lit(1).alias("c"), "finish")
               .union(queue.select(*keep, F.lit(0).alias("c"), none))
               .groupBy(*keep).agg(F.sum("c").alias("copies"), F.min("finish").alias("finish")))
    out = ["key", "doc_id", "source", "size", "source_size", "target", "copies", "finish"]
    return counted.select(*out).union(
        rows.filter("size = 0").select("key", "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long"), none))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: a row for each copy taken, all columns kept.

    Equal rows (id, source and text) share their copies evenly; what does not
    divide is added as further copies of one of them, so the mix holds exactly
    the planned words and no equal rows need be numbered."""
    plan = (fair_mix(docs, **params).groupBy(F.col("key").alias("__mix_key"))
            .agg(F.sum("copies").alias("__mix_sum"), F.count(F.lit(1)).alias("__mix_rows")).filter("__mix_sum > 0")
            .select("__mix_key", F.floor(F.col("__mix_sum") / F.col("__mix_rows")).cast("int").alias("__mix_each"),
                    (F.col("__mix_sum") % F.col("__mix_rows")).cast("int").alias("__mix_more")))
    plan = written(plan, "copies")
    keyed = docs.withColumn("__mix_key", row_key("doc_id", "source", "text"))
    times = lambda rows, n: rows.withColumn("__mix_turn", F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    each = times(keyed.join(plan.filter("__mix_each > 0"), "__mix_key"), "__mix_each")
    more = times(keyed.join(plan.filter("__mix_more > 0"), "__mix_key").dropDuplicates(["__mix_key"]), "__mix_more")
    return each.unionByName(more)
