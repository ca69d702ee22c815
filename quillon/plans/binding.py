"""Binding of the driver tables to quillon's canonical frames.

The engine's operators are domain-neutral: a *subject* has dated *code
events* (conditions), dated *item events* (the items recommended), visits
(encounters) and measurements (observations).  This module is the only
place that knows how the driver's TPC-H-like tables play those roles:

    subject            customer.c_custkey
    item events        lineitem JOIN orders: (o_custkey, l_partkey, date(l_shipdate))
    code events        lineitem JOIN orders JOIN part: (o_custkey, p_brand, date(o_orderdate))
    encounters         orders: (o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_totalprice)
    observations       events: (ts, user_id, event_type, value)
    demographics       first order date (start), c_acctbal < 0 (binary), c_mktsegment (category)

All frames are lazily defined; joins are left to Catalyst/AQE (no forced
broadcast of tables that grow with the data).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import prepare
from quillon.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values for the driver binding.
# Reference date used in place of "today" so that ages are reproducible.
AS_OF_DATE = "2002-01-01"
# Category encoding of the market segment (unknown -> 5).
SEGMENT_CODES = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2,
                 "HOUSEHOLD": 3, "MACHINERY": 4}
SEGMENT_OTHER = 5
# Five flag groups over condition codes (brands), sizes 3,1,1,1,3, with the
# phrase used in explanations.
FLAG_GROUPS = (
    ("has_group_a", ("Brand#1", "Brand#2", "Brand#3"), "group A affinity"),
    ("has_group_b", ("Brand#4",), "group B affinity"),
    ("has_group_c", ("Brand#5",), "group C affinity"),
    ("has_group_d", ("Brand#6",), "group D affinity"),
    ("has_group_e", ("Brand#7", "Brand#8", "Brand#9"), "group E affinity"),
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Frames:
    """Canonical frames for one data directory."""
    spark: SparkSession
    sf_dir: str

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- subjects -----------------------------------------------------------
    def subjects(self) -> DataFrame:
        """Spine: one row per subject (all customers, with or without events)."""
        return self.t("customer").select(
            F.col("c_custkey").alias("subject_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("category"),
            F.col("c_nationkey").alias("nation_key"),
            F.col("c_acctbal").alias("balance"),
        )

    def demographics_input(self) -> DataFrame:
        """subject_id, start_date, end_date, binary_value, category.

        start_date = first order date (null when the customer never ordered),
        end_date = null (still active), binary_value = 'Y' when balance < 0.
        """
        first = (self.t("orders")
                 .groupBy(F.col("o_custkey").alias("subject_id"))
                 .agg(F.min(F.to_date("o_orderdate")).alias("start_date")))
        return (self.subjects()
                .join(first, "subject_id", "left")
                .select("subject_id", "start_date",
                        F.lit(None).cast("date").alias("end_date"),
                        F.when(F.col("balance") < 0, F.lit("Y"))
                         .otherwise(F.lit("N")).alias("binary_value"),
                        "category"))

    # -- events -------------------------------------------------------------
    def _lines(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
        od = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(od, li.l_orderkey == od.o_orderkey)

    def item_rows(self) -> DataFrame:
        """Dated item events as they occur: an event may come more than once."""
        return (self._lines()
                .select(F.col("o_custkey").alias("subject_id"),
                        F.col("l_partkey").alias("item_id"),
                        F.to_date("l_shipdate").alias("start_date")))

    def item_events(self) -> DataFrame:
        """Dated item events, deduplicated on (subject, item, date)."""
        return self.item_rows().distinct()

    def code_rows(self) -> DataFrame:
        """Dated code events as they occur: an event may come more than once."""
        pt = self.t("part").select("p_partkey", "p_brand")
        return (self._lines().join(pt, F.col("l_partkey") == F.col("p_partkey"))
                .select(F.col("o_custkey").alias("subject_id"),
                        F.col("p_brand").alias("code"),
                        F.to_date("o_orderdate").alias("start_date")))

    def code_events(self) -> DataFrame:
        """Dated code events, deduplicated on (subject, code, date)."""
        return self.code_rows().distinct()

    def events(self) -> DataFrame:
        """Item and code events of one scan: subject_id, item_id or code (the
        other null), start_date; not deduplicated."""
        pt = self.t("part").select("p_partkey", "p_brand")
        item = F.struct(F.col("l_partkey").alias("item_id"), F.lit(None).cast("string").alias("code"), F.to_date("l_shipdate").alias("start_date"))
        code = F.struct(F.lit(None).cast("long").alias("item_id"), F.col("p_brand").alias("code"), F.to_date("o_orderdate").alias("start_date"))
        # An item without a part row has an item event and no code event.
        return (self._lines().join(pt, F.col("l_partkey") == F.col("p_partkey"), "left")
                .select(F.col("o_custkey").alias("subject_id"), F.inline(F.array(item, code)))
                .filter(F.col("item_id").isNotNull() | F.col("code").isNotNull()))

    def item_names(self) -> DataFrame:
        return self.t("part").select(F.col("p_partkey").alias("item_id"),
                                     F.col("p_name").alias("description"))

    def encounters(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("encounter_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderdate").alias("start_dt"),
            F.col("o_orderpriority").alias("encounterclass"),
            F.col("o_totalprice").alias("total_cost"))

    def observations(self) -> DataFrame:
        return self.t("events").select(
            F.col("ts").alias("date"),
            F.col("user_id").alias("subject_id"),
            F.col("event_type").alias("code"),
            F.col("value").alias("value"))


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    prepare(spark)
    return Frames(spark, sf_dir)


# SQL (DuckDB dialect, also valid Spark SQL where noted) for the same frames,
# used by the oracle strings.
SQL_ITEM_EVENTS = """
item_events AS (
  SELECT DISTINCT o.o_custkey AS subject_id, l.l_partkey AS item_id,
         CAST(l.l_shipdate AS DATE) AS start_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

SQL_CODE_EVENTS = """
code_events AS (
  SELECT DISTINCT o.o_custkey AS subject_id, p.p_brand AS code,
         CAST(o.o_orderdate AS DATE) AS start_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""
