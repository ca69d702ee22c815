"""Cleaning kit: one declarative spec per table.

A ``TableSpec`` says, per target column, its source column and how to parse
it, plus the required/non-empty columns, an optional date floor and the
dedup key.  ``clean`` applies, in the reference's order:
rename + keep-list projection -> drop nulls in required columns -> drop empty
strings -> parse -> date floor -> dedup on key.

Dedup keeps, per key, the row with the smallest remaining columns
(``min(struct(...))``): deterministic, and planned as a partial aggregate so a
key holding a third of all rows is reduced map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats of the raw files; timestamps are tried in this order.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
TS_FORMATS = (TS_FORMAT, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
DATE_FORMAT = "yyyy-MM-dd"


@dataclass(frozen=True)
class Col:
    source: str
    target: str
    kind: str = "string"   # string | date | timestamp | date_from_ts | double | upper | nullif_empty
    fmt: str | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple
    required: tuple = ()          # non-null (checked before parsing)
    non_empty: tuple = ()         # != '' (checked before parsing)
    key: tuple = ()               # dedup key (targets)
    floor: tuple | None = None    # (target column, 'yyyy-MM-dd'): keep rows strictly after
    keep_extra: bool = False      # keep source columns not in the spec (renamed ones replaced)


def _parse(c: Col) -> F.Column:
    x = F.col(c.target)
    if c.kind == "date":
        return F.try_to_date(x, c.fmt or DATE_FORMAT)
    if c.kind in ("timestamp", "date_from_ts"):
        ts = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ((c.fmt,) if c.fmt else TS_FORMATS)])
        return ts if c.kind == "timestamp" else F.to_date(ts)
    if c.kind == "double":
        return x.try_cast("double")
    if c.kind == "upper":
        return F.upper(x)
    if c.kind == "nullif_empty":
        return F.nullif(x, F.lit(""))
    return x


def project(df: DataFrame, spec: TableSpec) -> DataFrame:
    """P1 + P2: rename by the spec; keep only spec columns unless ``keep_extra``."""
    sel = [F.col(c.source).alias(c.target) for c in spec.columns if c.source in df.columns]
    if spec.keep_extra:
        used = {c.source for c in spec.columns}
        sel += [F.col(n) for n in df.columns if n not in used]
    return df.select(*sel)


def clean(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Full cleaning pipeline for one table."""
    out = project(df, spec)
    if spec.required:
        out = out.dropna(subset=list(spec.required))                       # P3
    for c in spec.non_empty:
        out = out.filter(F.col(c) != F.lit(""))                             # P4
    for c in spec.columns:
        if c.kind != "string" and c.target in out.columns:
            out = out.withColumn(c.target, _parse(c))                       # P7-P11
    if spec.floor:
        col, floor = spec.floor
        out = out.filter(F.col(col) > F.lit(floor).cast("date"))            # P5
    if spec.key:
        out = dedup(out, list(spec.key))                                    # P6
    return out


def dedup(df: DataFrame, key: list) -> DataFrame:
    """One row per key; the kept row is the smallest by the other columns."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*[F.col(k) for k in key], *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def reject_reason(df: DataFrame, spec: TableSpec) -> F.Column:
    """V3: why ``clean`` drops a raw row before dedup: 'null', 'empty', 'floor'
    (the first that applies), or null for a row that it keeps."""
    source = {c.target: c.source for c in spec.columns if c.source in df.columns}
    name = lambda c: F.col(source.get(c, c))
    null_req, empty = F.lit(False), F.lit(False)
    for c in spec.required:
        null_req = null_req | name(c).isNull()
    for c in spec.non_empty:
        empty = empty | F.coalesce(name(c) == F.lit(""), F.lit(False))
    reason = F.when(null_req, "null").when(empty, "empty")
    if spec.floor:
        col, floor = spec.floor
        parsed = [_parse(Col(c.source, c.source, c.kind, c.fmt)) for c in spec.columns if c.target == col][0]
        reason = reason.when(~F.coalesce(parsed > F.lit(floor).cast("date"), F.lit(False)), "floor")
    return reason


# -- sink and load -------------------------------------------------------------

def write_parquet(df: DataFrame, path: str, sort_by=None, partitions: int | None = None) -> None:
    """S3: overwrite + snappy; optional sort key (range partition + sort within
    partitions) so parquet min/max statistics skip row groups on that key."""
    out = df
    if sort_by:
        out = out.repartitionByRange(*( [partitions] if partitions else []), *sort_by).sortWithinPartitions(*sort_by)
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)


def load_to_schema(df: DataFrame, target_schema: T.StructType) -> DataFrame:
    """Keep the target's columns that the source has, cast to the target types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in target_schema.fields if f.name in df.columns])


# -- fixed values: the raw event tables' specs --------------------------------
SUBJECTS = TableSpec(
    "patients",
    (Col("Id", "patient_id"), Col("BIRTHDATE", "birthdate", "date"), Col("DEATHDATE", "deathdate", "date"),
     Col("SSN", "ssn"), Col("FIRST", "first"), Col("LAST", "last"), Col("GENDER", "gender", "upper"),
     Col("RACE", "race"), Col("ETHNICITY", "ethnicity"), Col("CITY", "city"), Col("STATE", "state"),
     Col("ZIP", "zip"), Col("LAT", "lat", "double"), Col("LON", "lon", "double"),
     Col("HEALTHCARE_EXPENSES", "healthcare_expenses", "double"),
     Col("HEALTHCARE_COVERAGE", "healthcare_coverage", "double")),
    required=("patient_id", "birthdate", "gender"), non_empty=("patient_id",), key=("patient_id",),
    floor=("birthdate", "1900-01-01"))
CODE_EVENTS = TableSpec(
    "conditions",
    (Col("START", "start_date", "date"), Col("STOP", "stop_date", "date"), Col("PATIENT", "patient_id"),
     Col("ENCOUNTER", "encounter_id"), Col("CODE", "code"), Col("DESCRIPTION", "description")),
    required=("patient_id", "code", "start_date"), non_empty=("patient_id", "code"),
    key=("patient_id", "code", "start_date"), floor=("start_date", "1900-01-01"), keep_extra=True)
ITEM_EVENTS = TableSpec(
    "medications",
    (Col("START", "start_date", "date_from_ts"), Col("STOP", "stop_date", "date_from_ts"),
     Col("PATIENT", "patient_id"), Col("ENCOUNTER", "encounter_id"), Col("CODE", "code"),
     Col("DESCRIPTION", "description"), Col("REASONCODE", "reasoncode"),
     Col("REASONDESCRIPTION", "reasondescription")),
    required=("patient_id", "code", "start_date"), non_empty=("patient_id", "code"),
    key=("patient_id", "code", "start_date"))
OBSERVATIONS = TableSpec(
    "observations",
    (Col("DATE", "date", "timestamp"), Col("PATIENT", "patient_id"), Col("ENCOUNTER", "encounter_id", "nullif_empty"),
     Col("CODE", "code"), Col("DESCRIPTION", "description"), Col("VALUE", "value"), Col("UNITS", "units"),
     Col("TYPE", "type")),
    required=("patient_id", "code", "value", "date"), non_empty=("patient_id", "code", "value"),
    key=("patient_id", "code", "date"))
ENCOUNTERS = TableSpec(
    "encounters",
    (Col("Id", "encounter_id"), Col("START", "start_dt", "timestamp"), Col("STOP", "stop_dt", "timestamp"),
     Col("PATIENT", "patient_id"), Col("ENCOUNTERCLASS", "encounterclass"), Col("CODE", "code"),
     Col("DESCRIPTION", "description"), Col("REASONCODE", "reasoncode"), Col("REASONDESCRIPTION", "reasondescription"),
     Col("BASE_ENCOUNTER_COST", "base_encounter_cost", "double"), Col("TOTAL_CLAIM_COST", "total_claim_cost", "double"),
     Col("PAYER_COVERAGE", "payer_coverage", "double")),
    required=("encounter_id", "patient_id", "start_dt"), non_empty=("encounter_id", "patient_id"),
    key=("encounter_id",))
PROCEDURES = TableSpec(
    "procedures",
    (Col("START", "date", "date_from_ts"), Col("PATIENT", "patient_id"), Col("ENCOUNTER", "encounter_id"),
     Col("CODE", "code"), Col("DESCRIPTION", "description"), Col("REASONCODE", "reasoncode"),
     Col("REASONDESCRIPTION", "reasondescription"), Col("BASE_COST", "base_cost", "double")),
    required=("patient_id", "code", "date"), non_empty=("patient_id", "code"),
    key=("patient_id", "code", "date", "encounter_id"))
RAW_SPECS = {s.name: s for s in (SUBJECTS, CODE_EVENTS, ITEM_EVENTS, OBSERVATIONS, ENCOUNTERS, PROCEDURES)}
# Pre-flight required columns per raw file (fixed values).
REQUIRED_RAW = {
    "patients": ("Id", "BIRTHDATE", "GENDER", "RACE"),
    "conditions": ("START", "PATIENT", "CODE", "DESCRIPTION"),
    "medications": ("START", "PATIENT", "CODE", "DESCRIPTION"),
    "observations": ("DATE", "PATIENT", "CODE", "DESCRIPTION", "VALUE"),
    "encounters": ("Id", "START", "PATIENT", "ENCOUNTERCLASS"),
    "procedures": ("START", "PATIENT", "CODE", "DESCRIPTION"),
}
