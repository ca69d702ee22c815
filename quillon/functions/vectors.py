"""Array-column expressions.

All are built-in higher-order functions, so they stay inside whole-stage
codegen; there is no Python UDF on this path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """``body(value)`` with the value computed once per row: an expression that a
    lambda refers to is evaluated anew for every element, a bound variable is not."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def dense_from_positions(positions, n) -> Column:
    """Multi-hot float vector of length ``n`` from an array of set positions."""
    positions = F.coalesce(_c(positions), F.array().cast("array<int>"))
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n <= 0, F.array().cast("array<float>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1),
                    lambda i: F.when(F.array_contains(positions, i), F.lit(1.0))
                               .otherwise(F.lit(0.0)).cast("float")))


def dense_from_entries(entries, n, default: float = 0.0) -> Column:
    """Dense double vector of length ``n`` from array<struct<pos:int, val:double>>."""
    m = F.map_from_entries(F.coalesce(_c(entries),
                                      F.array().cast("array<struct<pos:int,val:double>>")))
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(
        let(m, lambda v: F.transform(F.sequence(F.lit(0), n - 1),
                                     lambda i: F.coalesce(F.element_at(v, i), F.lit(default)).cast("double"))))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def smooth_l2_normalize(v, eps: float = 1e-4) -> Column:
    """T5: add ``eps`` to every element, then divide by the L2 norm.

    An all-zero input of length n becomes 1/sqrt(n) everywhere; length 0
    stays empty (the unguarded formula would divide by zero).
    """
    smoothed = F.transform(_c(v), lambda x: x.cast("double") + F.lit(eps))
    return let(smoothed, lambda sm: F.when(F.size(sm) == 0, F.array().cast("array<double>")).otherwise(
        let(l2_norm(sm), lambda nrm: F.transform(sm, lambda x: x / nrm))))


def to_float_array(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("float"))


def scale(v, w: float) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double") * F.lit(float(w)))


def weighted_concat(parts) -> Column:
    """Concat of (array column, weight) parts into one double vector."""
    return F.concat(*[scale(c, w) for c, w in parts])
