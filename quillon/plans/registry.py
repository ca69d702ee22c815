"""Named query registry: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
_OPS: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, ops: tuple = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is DuckDB SQL over the driver tables that must return the same
    rows; ``None`` means a rows-only check (random, ML or side-effect ops).
    ``ops`` lists the SURVEY operator ids the query exercises.
    """
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        _OPS[name] = tuple(ops)
        return fn
    return deco


def _load_all():
    # Importing the plan modules registers their queries.
    from quillon.plans import (q_features, q_clean, q_analytics, q_similarity,  # noqa: F401
                               q_recommend, q_metrics, q_evaluation, q_models)


def queries() -> dict:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load_all()
    return dict(_ORACLE)


def operator_map() -> dict:
    _load_all()
    return dict(_OPS)
