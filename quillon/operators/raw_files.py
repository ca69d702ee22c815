"""The raw CSV path: read, validate, clean, write, report.

Files are only touched through Spark's readers, so any path that executors can
open works.  Rows whose field count does not fit the header are kept apart by
the reader's corrupt-record column; sizes come from its file metadata.  Reject
counts are gathered by observations on the one job that writes the cleaned
table, not by a second scan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import clean as C

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file source finds anything at the path."""
    try:
        spark.read.text(path).schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line; none for an empty file."""
    return spark.read.option("header", "true").csv(path).columns


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, plus ``_corrupt_record``: the whole line of a
    row with too few or too many fields, else null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header(spark, path), CORRUPT]])
    return (spark.read.option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("multiLine", "false").schema(schema).csv(path))


@dataclass(frozen=True)
class FileReport:
    table: str
    rows: int
    malformed: int
    bytes: int


def validate_file(spark: SparkSession, path: str, table: str, required) -> FileReport:
    """V1: raise for a missing or empty file, a missing column, no data rows;
    else rows, malformed rows and bytes, all of one pass."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{table}: no file at {path}")
    found = header(spark, path)
    if not found:
        raise ValueError(f"{table}: empty file {path}")
    missing = sorted(set(required) - set(found))
    if missing:
        raise ValueError(f"{table}: missing required columns {', '.join(missing)}")
    # The reader parses whole rows only if some field is asked for beside the corrupt record.
    per_file = (read_raw(spark, path).select("_metadata.file_path", "_metadata.file_size", F.col(CORRUPT).isNotNull().alias("bad"), *found)
                .groupBy("file_path").agg(F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                          F.count_if("bad").alias("bad"), *[F.count(F.col(f"`{c}`")).alias(f"n_{k}") for k, c in enumerate(found)]))
    row = per_file.agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"), F.sum("bytes").alias("bytes"),
                       *[F.sum(f"n_{k}").alias(f"n_{k}") for k in range(len(found))]).first()
    if not row["rows"]:
        raise ValueError(f"{table}: header without data rows")
    return FileReport(table, row["rows"], row["bad"], row["bytes"])


def raw_folder(spark: SparkSession, folder: str, tables) -> str:
    """The folder itself or its ``csv`` sub-folder, whichever holds a table."""
    for base in (f"{folder}/csv", folder):
        if any(exists(spark, f"{base}/{t}.csv") for t in tables):
            return base
    raise FileNotFoundError(f"no raw files in {folder}")


def validate_all(spark: SparkSession, folder: str, tables: dict = C.REQUIRED_RAW) -> list[FileReport]:
    """V2: every table, failing at the first problem."""
    base = raw_folder(spark, folder, tables)
    return [validate_file(spark, f"{base}/{t}.csv", t, required) for t, required in tables.items()]


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """V4: the frame, if it has a row; else an error."""
    if df.isEmpty():
        raise ValueError(f"{name}: no rows")
    return df


REPORT = ("table_name string, raw_rows long, clean_rows long, dropped_malformed long, dropped_null long, dropped_empty long, "
          "dropped_floor long, dropped_duplicate long")


def clean_and_write(raw: DataFrame, spec: C.TableSpec, path: str, sort_by=None) -> tuple:
    """Clean a raw table, write it (S3) and return its report row (V3).

    Both observations ride on the job that writes; each drop is counted under
    the first reason that applies.  A stage that is run again after a lost
    executor may count its rows twice, so the report is of a run, while the
    written rows are exact whatever happens."""
    before, after = Observation(), Observation()
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    reason = F.when(bad, "malformed").otherwise(C.reject_reason(raw, spec))
    told = raw.withColumn("_reason", reason).observe(before, F.count(F.lit(1)).alias("raw"), *[
        F.count_if(F.col("_reason") == r).alias(r) for r in ("malformed", "null", "empty", "floor")])
    kept = told.filter(F.col("_reason").isNull()).drop("_reason", CORRUPT)
    out = C.clean(kept, spec).observe(after, F.count(F.lit(1)).alias("clean"))
    C.write_parquet(out, path, sort_by)
    b, clean_rows = before.get, after.get["clean"]
    valid = b["raw"] - b["malformed"] - b["null"] - b["empty"] - b["floor"]
    return spec.name, b["raw"], clean_rows, b["malformed"], b["null"], b["empty"], b["floor"], valid - clean_rows


def clean_tables(spark: SparkSession, raw: dict, folder: str, specs: dict = C.RAW_SPECS) -> DataFrame:
    """Clean and write every given raw table under ``folder``; one report row each.

    The tables' jobs run side by side, so that the last tasks of one table leave no
    core idle."""
    one = inheritable_thread_target(spark)(lambda name: clean_and_write(raw[name], specs[name], f"{folder}/{name}"))
    with ThreadPoolExecutor(max(1, len(raw))) as pool:
        rows = list(pool.map(one, raw))
    return spark.createDataFrame(rows, REPORT)


def clean_folder(spark: SparkSession, raw_folder_path: str, out: str, tables: dict = C.REQUIRED_RAW) -> DataFrame:
    """The whole path of a CSV drop: validate, read, clean, write, report."""
    reports = validate_all(spark, raw_folder_path, tables)
    base = raw_folder(spark, raw_folder_path, tables)
    return clean_tables(spark, {r.table: read_raw(spark, f"{base}/{r.table}.csv") for r in reports}, out)


def replace_table(df: DataFrame, target: T.StructType, path: str) -> DataFrame:
    """Truncate and load: the target's columns that the source has, cast to
    its types, replace what the path holds; the loaded table is returned."""
    C.load_to_schema(df, target).write.mode("overwrite").parquet(path)
    return require_rows(df.sparkSession.read.parquet(path), path)


def append_table(df: DataFrame, target: T.StructType, path: str) -> DataFrame:
    """Add part files of the target's columns beside those already there."""
    C.load_to_schema(df, target).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)
