"""Feature store: one row per subject.

All groups read one frame of (subject, item or code) pairs, made by one scan
of the events; joins to the spine reuse the hash partitioning on
``subject_id``.  Per-subject arrays are built from at most N vocabulary
positions, so no unbounded per-subject list is ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import encode as E
from quillon.functions import vectors as V
from quillon.operators import vocab as voc

# Version stamp and smoothing of the feature rows.
FEATURE_VERSION = "v1.0"
EPSILON = 1e-4


@dataclass(frozen=True)
class FeatureSpec:
    as_of: str
    binary_positive: str
    category_map: dict
    category_other: int
    flag_groups: tuple  # ((flag column, codes, phrase), ...)
    top_n_codes: int = 50
    top_n_items: int = 50


def demographics(demo: DataFrame, spec: FeatureSpec) -> DataFrame:
    """subject_id, age, binary_code, category_code."""
    return demo.select(
        "subject_id",
        E.age_years("start_date", "end_date", spec.as_of).alias("age"),
        E.binary_code("binary_value", spec.binary_positive).alias("binary_code"),
        E.category_code("category", spec.category_map, spec.category_other).alias("category_code"),
    )


def _flag(codes) -> F.Column:
    """A2: whether any code of the group is in the set, as tinyint."""
    return F.coalesce(F.bool_or(F.col("code").isin(list(codes))), F.lit(False)).cast("tinyint")


def event_pairs(events: DataFrame) -> DataFrame:
    """One row per (subject, item or code): ``raw_count`` distinct dates (A4) and
    the last one (A9).

    ``events`` holds subject_id, item_id or code (the other null) and
    start_date, so that all groups of a feature row share one scan.  Both
    aggregates combine map-side; a hot subject is spread over its keys."""
    key = ["subject_id", "item_id", "code"]
    return (events.select(*key, "start_date").distinct().groupBy(*key)
            .agg(F.count(F.lit(1)).alias("raw_count"), F.max("start_date").alias("last_date")))


def as_events(item_events: DataFrame, code_events: DataFrame) -> DataFrame:
    """The two event frames as one tagged frame (for separate sources)."""
    return (item_events.select("subject_id", "item_id", F.lit(None).cast("string").alias("code"), "start_date")
            .unionByName(code_events.select("subject_id", F.lit(None).cast("long").alias("item_id"), "code", "start_date")))


def _vocabulary(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """W1 from pairs: a pair row is one subject that holds the key (A5)."""
    held = pairs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("subject_count"))
    return voc.top_n_vocabulary(held, n, key=key)


def _counts(spec: FeatureSpec) -> list:
    """A1, A2: distinct codes and items, and the flags (pairs are distinct)."""
    return [F.count("code").cast("int").alias("num_codes"), F.count("item_id").cast("int").alias("num_items"),
            *[_flag(codes).alias(name) for name, codes, _ in spec.flag_groups]]


def encounter_counts(encounters: DataFrame) -> DataFrame:
    """Visits per subject."""
    return encounters.groupBy("subject_id").agg(F.count("encounter_id").cast("int").alias("num_encounters"))


SCALAR_COLS_BASE = ("age", "binary_code", "category_code", "num_codes", "num_items", "num_encounters")


def scalar_columns(spec: FeatureSpec) -> list[str]:
    return list(SCALAR_COLS_BASE) + [g[0] for g in spec.flag_groups]


def feature_rows(demo_input: DataFrame, spine: DataFrame, pairs: DataFrame, encounters: DataFrame, spec: FeatureSpec,
                 keep_double_vector: bool = False) -> DataFrame:
    """The full feature row per subject (stamp columns P24 included).

    ``pairs`` is a stored ``event_pairs`` frame: both vocabularies and one
    conditional aggregate per subject read it.  Vector entries are collected
    for vocabulary keys only, so a list has at most N entries."""
    items = _vocabulary(pairs, "item_id", spec.top_n_items)
    codes = _vocabulary(pairs, "code", spec.top_n_codes)
    total = spine.agg(F.count(F.lit(1))).scalar()
    idf = voc.smoothed_idf(items, total).select("item_id", F.col("pos").alias("_ipos"), "idf")
    entry = F.when(F.col("_ipos").isNotNull(), F.struct(
        F.col("_ipos").cast("int").alias("pos"), (F.log1p(F.col("raw_count").cast("double")) * F.col("idf")).cast("double").alias("val")))
    per = (pairs.join(F.broadcast(idf), "item_id", "left").join(F.broadcast(codes.select("code", F.col("pos").alias("_cpos"))), "code", "left")
           .groupBy("subject_id").agg(*_counts(spec), F.collect_list("_cpos").alias("_codes"), F.collect_list(entry).alias("_items")))
    n_items, n_codes = (v.agg(F.count(F.lit(1)).cast("int")).scalar() for v in (items, codes))
    cols = (["subject_id"] + scalar_columns(spec) + ["code_vector", "item_vector"]
            + (["item_vector_d", "item_nonzero"] if keep_double_vector else []))
    return (_joined(demo_input, per, encounters, spec)
            .withColumn("_ni", n_items).withColumn("_nc", n_codes)  # scalar subqueries projected once, outside the lambdas
            .withColumn("code_vector", V.dense_from_positions("_codes", F.col("_nc")))  # T1 + T2
            .withColumn("item_vector_d", V.smooth_l2_normalize(V.dense_from_entries("_items", F.col("_ni")), EPSILON))
            .withColumn("item_vector", V.to_float_array("item_vector_d"))
            .withColumn("item_nonzero", F.coalesce(F.size(F.filter("_items", lambda x: x["val"] != 0)), F.lit(0)))  # before smoothing
            .select(*cols)
            .withColumn("feature_version", F.lit(FEATURE_VERSION))
            .withColumn("created_at", F.current_timestamp()))


def _joined(demo_input: DataFrame, per_subject: DataFrame, encounters: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Demographics with the aggregates, 0 where a subject has none."""
    return (demographics(demo_input, spec).join(per_subject, "subject_id", "left").join(encounter_counts(encounters), "subject_id", "left")
            .fillna(0, subset=["num_codes", "num_items", "num_encounters"] + [g[0] for g in spec.flag_groups]))


def scalar_feature_rows(demo_input: DataFrame, pairs: DataFrame, encounters: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The feature row without the vectors (no vocabulary work is planned)."""
    per = pairs.groupBy("subject_id").agg(*_counts(spec))
    return _joined(demo_input, per, encounters, spec).select("subject_id", *scalar_columns(spec))
