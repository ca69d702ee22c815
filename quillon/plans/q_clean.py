"""Cleaning / validation queries on the driver tables.

The driver tables are typed parquet; to exercise the raw-file path they are
rendered as all-string rows in the raw formats (timestamps as
yyyy-MM-dd'T'HH:mm:ss'Z', dates as yyyy-MM-dd, missing as ''), then cleaned by
the same specs a raw CSV drop would use.  Where a key leaves a certain rest
a field is dirty: missing, empty, unparseable, too early, or in the second
timestamp format.  The SQL states the same rests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.encode import date_floor
from quillon.operators import clean as C
from quillon.operators import raw_files as RF
from quillon.plans import binding as B
from quillon.plans.registry import query
from quillon.session import checkpoint_dir

_TS, _TS2 = C.TS_FORMATS[:2]


def _s(c):
    return F.col(c).cast("string")


def _when(key: str, value, *dirt):
    """``value``, or the replacement of the first (modulus, rest) that the key meets."""
    out = None
    for n, rest, other in dirt:
        hit = F.col(key) % n == rest
        other = F.lit(other).cast("string") if other is None or isinstance(other, str) else other
        out = F.when(hit, other) if out is None else out.when(hit, other)
    return out.otherwise(value)


def _dirty_ts(key: str, ts: str):
    return _when(key, F.date_format(ts, _TS), (43, 4, None), (37, 2, "not a time"), (31, 1, F.date_format(ts, _TS2)))


def raw_encounters(spark, d):
    o = B.frames(spark, d).t("orders")
    return o.select(_s("o_orderkey").alias("Id"), _dirty_ts("o_orderkey", "o_orderdate").alias("START"),
                    F.lit("").alias("STOP"), _when("o_orderkey", _s("o_custkey"), (41, 3, "")).alias("PATIENT"),
                    F.col("o_orderpriority").alias("ENCOUNTERCLASS"), F.col("o_orderstatus").alias("CODE"),
                    F.lit("").alias("DESCRIPTION"), F.lit("").alias("REASONCODE"), F.lit("").alias("REASONDESCRIPTION"),
                    F.lit("").alias("BASE_ENCOUNTER_COST"), _when("o_orderkey", _s("o_totalprice"), (47, 5, "n/a")).alias("TOTAL_CLAIM_COST"),
                    F.lit("").alias("PAYER_COVERAGE"))


def raw_medications(spark, d):
    f = B.frames(spark, d)
    li = f.t("lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = f.t("orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(_dirty_ts("l_orderkey", "l_shipdate").alias("START"), F.lit("").alias("STOP"),
                    _s("o_custkey").alias("PATIENT"), F.lit("").alias("PAYER"), _s("l_orderkey").alias("ENCOUNTER"),
                    _when("l_orderkey", _s("l_partkey"), (41, 3, "")).alias("CODE"), F.lit("").alias("DESCRIPTION"),
                    F.lit("").alias("REASONCODE"), F.lit("").alias("REASONDESCRIPTION"))


def raw_patients(spark, d):
    f = B.frames(spark, d)
    first = f.t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    c = f.t("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = "c_custkey"
    return c.select(_when(k, _s(k), (19, 4, "")).alias("Id"),
                    _when(k, F.date_format("first", "yyyy-MM-dd"), (11, 1, "1890-05-05"), (13, 2, "05/05/1990")).alias("BIRTHDATE"),
                    F.lit("").alias("DEATHDATE"), F.lit("").alias("SSN"), F.col("c_name").alias("FIRST"),
                    F.lit("").alias("LAST"),
                    _when(k, F.when(F.col("c_acctbal") < 0, F.lit("m")).otherwise(F.lit("f")), (17, 3, None)).alias("GENDER"),
                    F.col("c_mktsegment").alias("RACE"), F.lit("").alias("ETHNICITY"), F.lit("").alias("CITY"),
                    F.lit("").alias("STATE"), F.lit("").alias("ZIP"), F.lit("").alias("LAT"), F.lit("").alias("LON"),
                    _when(k, _s("c_acctbal"), (23, 5, "abc")).alias("HEALTHCARE_EXPENSES"), F.lit("").alias("HEALTHCARE_COVERAGE"))


def raw_conditions(spark, d):
    f = B.frames(spark, d)
    j = (f.t("lineitem").select("l_orderkey", "l_partkey").join(f.t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(f.t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")))
    k = "l_orderkey"
    return j.select(_when(k, F.date_format("o_orderdate", "yyyy-MM-dd"), (29, 1, "1850-01-01"), (41, 4, "2020-13-45")).alias("START"),
                    F.lit("").alias("STOP"), _when(k, _s("o_custkey"), (37, 3, None)).alias("PATIENT"), _s(k).alias("ENCOUNTER"),
                    _when(k, F.col("p_brand"), (31, 2, "")).alias("CODE"), F.lit("").alias("DESCRIPTION"))


def raw_observations(spark, d):
    e = B.frames(spark, d).t("events")
    return e.select(_when("user_id", F.date_format("ts", _TS), (41, 3, "soon"), (31, 1, F.date_format("ts", _TS2))).alias("DATE"),
                    _s("user_id").alias("PATIENT"),
                    F.lit("").alias("ENCOUNTER"), F.lit("").alias("CATEGORY"), F.col("event_type").alias("CODE"),
                    F.lit("").alias("DESCRIPTION"), _when("user_id", _s("value"), (43, 4, None), (37, 2, "")).alias("VALUE"),
                    F.lit("").alias("UNITS"), F.lit("numeric").alias("TYPE"))


RAW = {"medications": raw_medications, "conditions": raw_conditions, "encounters": raw_encounters,
       "observations": raw_observations, "patients": raw_patients}

# The same tables as parsed values with their dirt: ``key`` for dedup and, per
# row, whether a required value is missing, empty, or before the floor.
_RAW_SQL = """WITH
enc AS (SELECT *, coalesce(k::VARCHAR, 'null') AS key FROM (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS encounter_id, CASE WHEN o_orderkey % 37 = 2 THEN NULL ELSE o_orderdate END AS start_dt,
    CASE WHEN o_orderkey % 41 = 3 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS patient_id, o_orderpriority AS encounterclass,
    o_orderstatus AS code, CASE WHEN o_orderkey % 47 = 5 THEN NULL ELSE o_totalprice END AS total_claim_cost,
    o_orderkey % 43 = 4 OR o_orderkey IS NULL OR o_custkey IS NULL OR o_orderdate IS NULL AS no_value, o_orderkey % 41 = 3 AS blank, false AS early
  FROM orders)),
med AS (SELECT *, concat_ws('|', coalesce(start_date::VARCHAR, 'null'), patient_id, code) AS key FROM (
  SELECT CASE WHEN l_orderkey % 37 = 2 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS start_date, CAST(o_custkey AS VARCHAR) AS patient_id,
    CAST(l_orderkey AS VARCHAR) AS encounter_id, CASE WHEN l_orderkey % 41 = 3 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS code,
    l_orderkey % 43 = 4 OR l_shipdate IS NULL OR o_custkey IS NULL OR l_partkey IS NULL AS no_value, l_orderkey % 41 = 3 AS blank, false AS early
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
pat AS (SELECT *, patient_id AS key, birthdate IS NULL OR birthdate <= DATE '1900-01-01' AS early FROM (
  SELECT CASE WHEN c_custkey % 19 = 4 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS patient_id, c_custkey AS k,
    CASE WHEN c_custkey % 11 = 1 THEN DATE '1890-05-05' WHEN c_custkey % 13 = 2 THEN NULL ELSE CAST(f.first AS DATE) END AS birthdate,
    c_name AS first, CASE WHEN c_acctbal < 0 THEN 'M' ELSE 'F' END AS gender, c_mktsegment AS race,
    CASE WHEN c_custkey % 23 = 5 THEN NULL ELSE c_acctbal END AS healthcare_expenses,
    c_custkey IS NULL OR c_custkey % 17 = 3 OR (f.first IS NULL AND c_custkey % 11 <> 1 AND c_custkey % 13 <> 2) AS no_value,
    c_custkey % 19 = 4 AS blank
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey)),
con AS (SELECT *, concat_ws('|', start_date, patient_id, code) AS key, start_date IS NULL OR start_date <= DATE '1900-01-01' AS early FROM (
  SELECT CASE WHEN l_orderkey % 29 = 1 THEN DATE '1850-01-01' WHEN l_orderkey % 41 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date,
    CAST(o_custkey AS VARCHAR) AS patient_id, p_brand AS code,
    l_orderkey % 37 = 3 OR o_custkey IS NULL OR p_brand IS NULL OR o_orderdate IS NULL AS no_value, l_orderkey % 31 = 2 OR p_brand = '' AS blank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)),
obs AS (SELECT *, concat_ws('|', coalesce(date::VARCHAR, 'null'), patient_id, code) AS key FROM (
  SELECT CASE WHEN user_id % 41 = 3 THEN NULL ELSE date_trunc('second', ts) END AS date, CAST(user_id AS VARCHAR) AS patient_id, event_type AS code,
    CAST(value AS VARCHAR) AS value, user_id % 43 = 4 OR ts IS NULL OR user_id IS NULL OR event_type IS NULL OR value IS NULL AS no_value,
    user_id % 37 = 2 OR event_type = '' AS blank, false AS early
  FROM events))
"""
_KEPT = "WHERE NOT no_value AND NOT blank AND NOT early"


@query("clean_encounters", ops=("P1", "P2", "P3", "P4", "P6", "P8", "P9", "P11", "S5"), sql=_RAW_SQL + f"""
SELECT encounter_id, start_dt, CAST(NULL AS TIMESTAMP) AS stop_dt, patient_id, encounterclass, code,
       '' AS description, '' AS reasoncode, '' AS reasondescription, CAST(NULL AS DOUBLE) AS base_encounter_cost,
       total_claim_cost, CAST(NULL AS DOUBLE) AS payer_coverage FROM enc {_KEPT}""")
def q_clean_encounters(spark, d):
    return C.clean(raw_encounters(spark, d), C.ENCOUNTERS)


@query("clean_medications", ops=("P1", "P2", "P3", "P4", "P6", "P8", "S5"), sql=_RAW_SQL + f"""
SELECT start_date, CAST(NULL AS DATE) AS stop_date, patient_id, min(encounter_id) AS encounter_id,
       code, '' AS description, '' AS reasoncode, '' AS reasondescription
FROM med {_KEPT} GROUP BY start_date, patient_id, code""")
def q_clean_medications(spark, d):
    return C.clean(raw_medications(spark, d), C.ITEM_EVENTS)


@query("clean_patients", ops=("P1", "P2", "P3", "P4", "P5", "P6", "P7", "P9", "P10"), sql=_RAW_SQL + f"""
SELECT patient_id, birthdate, CAST(NULL AS DATE) AS deathdate,
       '' AS ssn, first, '' AS last, gender, race, '' AS ethnicity, '' AS city, '' AS state, '' AS zip,
       CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, healthcare_expenses,
       CAST(NULL AS DOUBLE) AS healthcare_coverage
FROM pat {_KEPT}""")
def q_clean_patients(spark, d):
    return C.clean(raw_patients(spark, d), C.SUBJECTS)


@query("clean_observations", ops=("P1", "P2", "P3", "P4", "P6", "P8", "P11"), sql=_RAW_SQL + f"""
SELECT date, patient_id, CAST(NULL AS VARCHAR) AS encounter_id,
       code, '' AS description, min(value) AS value, '' AS units, 'numeric' AS type
FROM obs {_KEPT} GROUP BY date, patient_id, code""")
def q_clean_observations(spark, d):
    return C.clean(raw_observations(spark, d), C.OBSERVATIONS)


def _report_sql(tables: dict, malformed: str = "false", no_value: str = "no_value") -> str:
    each = " UNION ALL ".join(f"SELECT '{name}' AS table_name, key, {malformed.format(name=name)} AS malformed, {no_value} AS no_value, blank, early FROM {cte}"
                              for name, cte in tables.items())
    return _RAW_SQL + f""", told AS (SELECT table_name, key, CASE WHEN malformed THEN 4 WHEN no_value THEN 1 WHEN blank THEN 2 WHEN early THEN 3 ELSE 0 END AS reason
  FROM ({each}))
SELECT table_name, count(*) AS raw_rows, count(DISTINCT key) FILTER (reason = 0) AS clean_rows, count(*) FILTER (reason = 4) AS dropped_malformed,
       count(*) FILTER (reason = 1) AS dropped_null, count(*) FILTER (reason = 2) AS dropped_empty, count(*) FILTER (reason = 3) AS dropped_floor,
       count(*) FILTER (reason = 0) - count(DISTINCT key) FILTER (reason = 0) AS dropped_duplicate"""


_CTE = {"medications": "med", "conditions": "con", "encounters": "enc", "observations": "obs", "patients": "pat"}


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/clean-{uuid.uuid4().hex}"


def _report(spark, d, names):
    return RF.clean_tables(spark, {n: RAW[n](spark, d) for n in names}, _scratch(spark))


@query("clean_report", ops=("V3", "V4"), sql=_report_sql({k: _CTE[k] for k in ("medications", "patients")}) + " FROM told GROUP BY table_name")
def q_clean_report(spark, d):
    """The report of two tables; ``clean_report_all`` has the others too."""
    return _report(spark, d, ("medications", "patients"))


@query("clean_report_all", ops=("V3", "V4", "S3"), sql=_report_sql(_CTE) + " FROM told GROUP BY table_name")
def q_clean_report_all(spark, d):
    """The report over every raw table that the driver tables can fill (none plays
    the part of procedures), gathered while the cleaned tables are written."""
    return _report(spark, d, _CTE)


def _write_csv(raw, path: str):
    """A raw frame as CSV lines with a header in every file; where the id leaves a
    certain rest, the line lacks fields or has one too many."""
    line = F.to_csv(F.struct(*raw.columns))
    k = F.col("Id").try_cast("long")  # an empty id breaks no line
    cut = F.when(k % 59 == 7, F.substring_index(line, ",", 3)).when(k % 61 == 8, F.concat(line, F.lit(",extra"))).otherwise(line)
    names = ",".join(raw.columns)

    def with_header(batches):
        import pandas as pd
        yield pd.DataFrame({"value": [names]})
        yield from batches

    raw.select(cut.alias("value")).mapInPandas(with_header, "value string").write.mode("overwrite").text(path)


@query("csv_clean_report", ops=("S1", "V1", "V2", "V3", "V4", "S3"), sql=_report_sql(
    {k: _CTE[k] for k in ("encounters", "patients")}, "coalesce(k % 59 = 7 OR k % 61 = 8, false) AND NOT ('{name}' = 'patients' AND blank)",
    "no_value OR blank") + ", count(DISTINCT key) FILTER (reason = 0) AS written_rows FROM told GROUP BY table_name")
def q_csv_clean_report(spark, d):
    """A CSV drop with broken lines, from files to cleaned tables: validated, read
    as strings, cleaned, written and read back.  An empty field of a CSV file is
    a missing value to the reader, so none is left to drop as empty."""
    folder, out = _scratch(spark), _scratch(spark)
    _write_csv(raw_encounters(spark, d), f"{folder}/csv/encounters.csv")
    _write_csv(raw_patients(spark, d), f"{folder}/csv/patients.csv")
    report = RF.clean_folder(spark, folder, out, {t: C.REQUIRED_RAW[t] for t in ("encounters", "patients")})
    written = [(t, spark.read.parquet(f"{out}/{t}").count()) for t in ("encounters", "patients")]
    return report.join(spark.createDataFrame(written, "table_name string, written_rows long"), "table_name")


@query("load_to_schema", ops=("S4", "S6", "P12"), sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id,
       greatest(CASE WHEN o_orderkey % 53 = 6 THEN DATE '1901-01-01' ELSE CAST(o_orderdate AS DATE) END, DATE '1925-01-01') AS start_date,
       CAST(o_custkey AS VARCHAR) AS patient_id FROM orders""")
def q_load_to_schema(spark, d):
    """Bulk load: keep the target's columns (unknown source columns dropped), cast
    to target types, clamp dates to the 1925-01-01 floor; finished orders replace
    the table, the others are appended as part files."""
    target = T.StructType([T.StructField("encounter_id", T.StringType()),
                           T.StructField("start_date", T.DateType()),
                           T.StructField("patient_id", T.StringType()),
                           T.StructField("not_in_source", T.StringType())])
    day = F.when(F.col("o_orderkey") % 53 == 6, F.lit("1901-01-01").cast("date")).otherwise(F.to_date("o_orderdate"))
    src = B.frames(spark, d).t("orders").select(
        F.col("o_orderkey").alias("encounter_id"), date_floor(day, "1925-01-01").alias("start_date"),
        F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("not_in_target"))
    path, done = _scratch(spark), F.coalesce(F.col("not_in_target") == "F", F.lit(False))
    RF.replace_table(src.filter(done), target, path)
    return RF.append_table(src.filter(~done), target, path)
