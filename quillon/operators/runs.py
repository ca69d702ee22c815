"""Run table: latest run per model, normalised score, promotion, comparison
(W6, W7, E15, E16, E17).  A run table is small (one row per run and metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.operators.metrics import normalised_score

# The metric each model type is judged by.
PRIMARY_METRIC = {"als": "rmse", "neighbour": "ndcg_at_k", "pair_model": "auc_roc", "popularity": "ndcg_at_k"}


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per model type (ties by run_id)."""
    w = Window.partitionBy("model_type").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def scored_runs(metrics: DataFrame, primary: dict = PRIMARY_METRIC) -> DataFrame:
    """One row per run with its primary metric normalised (rmse -> 1/(1+rmse)); missing -> -1."""
    m = F.create_map(*[x for k, v in primary.items() for x in (F.lit(k), F.lit(v))])
    runs = metrics.select("run_id", "model_type", "started_at").distinct()
    prim = metrics.filter(F.col("metric") == F.element_at(m, F.col("model_type")))
    return (runs.join(prim.select("run_id", "metric", "value"), "run_id", "left")
            .withColumn("metric", F.coalesce(F.col("metric"), F.element_at(m, F.col("model_type"))))
            .withColumn("score", normalised_score("metric", "value")))


def best_run(scored: DataFrame) -> DataFrame:
    """Argmax of score with tie-break on run_id."""
    return scored.agg(F.max_by("run_id", F.struct(F.col("score"), F.col("run_id"))).alias("run_id"))


def promote(registry: DataFrame, winner: DataFrame) -> DataFrame:
    """The winner becomes 'Production', any previous 'Production' becomes
    'Archived', everything else keeps its status."""
    r = registry.withColumn("_win", winner.select("run_id").scalar())  # scalar subquery
    return r.withColumn("status", F.when(F.col("run_id") == F.col("_win"), F.lit("Production"))
                                   .when(F.col("status") == "Production", F.lit("Archived"))
                                   .otherwise(F.col("status"))).drop("_win")


def compare(metrics: DataFrame, metric_names) -> DataFrame:
    """Metric by model (pivot with explicit values, so no extra distinct job)."""
    return metrics.groupBy("model_type").pivot("metric", list(metric_names)).agg(F.first("value"))
