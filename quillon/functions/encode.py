"""Scalar encoders and derived values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def binary_code(col, positive: str) -> Column:
    """P13 (binary): 1 when equal to ``positive`` else 0, as tinyint."""
    return F.when(_c(col) == F.lit(positive), F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def category_code(col, mapping: dict, other: int) -> Column:
    """P13 (category): case-insensitive lookup, unknown or null -> ``other``."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k.lower()), F.lit(int(v)))])
    return F.coalesce(F.element_at(m, F.lower(_c(col))), F.lit(int(other))).cast("tinyint")


def category_label(col, labels: dict, default: str = "Unknown") -> Column:
    """Code -> label with a default."""
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(int(k)), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(col).cast("int")), F.lit(default))


def age_years(start, end, as_of: str) -> Column:
    """int(datediff(coalesce(end, as_of), start) / 365.25), truncated."""
    stop = F.coalesce(_c(end), F.lit(as_of).cast("date"))
    return (F.datediff(stop, _c(start)) / F.lit(365.25)).cast("int")


def calendar_age(start, as_of: str) -> Column:
    """year(as_of) - year(start)."""
    return (F.year(F.lit(as_of).cast("date")) - F.year(_c(start))).cast("int")


def score_badge(score, high: float = 0.8, mid: float = 0.6) -> Column:
    """P21: 'high' above ``high``, 'medium' above ``mid``, else 'low'."""
    s = _c(score)
    return (F.when(s > high, F.lit("high"))
             .when(s > mid, F.lit("medium"))
             .otherwise(F.lit("low")))


def clip_upper(col, cap: float) -> Column:
    """Winsorise from above (null stays null)."""
    return F.least(_c(col), F.lit(cap))


def date_floor(col, floor: str, kind: str = "date") -> Column:
    """Clamp a date (``kind='date'``) or timestamp to a floor; null stays null."""
    c = _c(col)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(floor).cast(kind)))
