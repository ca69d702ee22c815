"""The profile page of subjects (A26): items newest first, stored recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranking as R

COLUMNS = ("subject_id", "part", "place", "item_id", "item_name", "last_date", "score")


def profile(history: DataFrame, store: DataFrame, names: DataFrame, stored: int = 10) -> tuple[DataFrame, DataFrame]:
    """(items, recommendations) of all subjects in ``history`` and ``store``,
    with the same columns; for one subject, filter both inputs first.

    A name is the smallest of an item's descriptions; items without one have
    none.  Places count from 1: items by last date, newest first (ties: larger
    item first), recommendations by rank."""
    named = names.groupBy("item_id").agg(F.min("description").alias("item_name"))
    items = (R.recency_rank(history.select("subject_id", "item_id", "last_date")).join(named, "item_id", "left")
             .select("subject_id", F.lit("item").alias("part"), (F.col("recency") + 1).cast("int").alias("place"), "item_id", "item_name",
                     "last_date", F.lit(None).cast("double").alias("score")))
    recs = (store.filter(F.col("rank") <= stored).join(named, "item_id", "left")
            .select("subject_id", F.lit("recommendation").alias("part"), F.col("rank").cast("int").alias("place"), "item_id", "item_name",
                    F.lit(None).cast("date").alias("last_date"), F.col("score").cast("double").alias("score")))
    return items.select(*COLUMNS), recs.select(*COLUMNS)
