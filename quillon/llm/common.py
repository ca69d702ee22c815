"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import checkpoint_dir
from quillon.sources.tables import read_table

# A word of the contracts: a run without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder.

    Smaller on disk than ``checkpoint()`` and readable by every executor, so
    a lost executor costs nothing that was computed before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    note(path)
    return spark.read.schema(df.schema).parquet(path)


def note(path: str, table: str | None = None) -> None:
    """Tell an open ``noted`` block of an intermediate table."""
    made = _MADE.get()
    if made is not None:
        made.append((path, table))


@contextmanager
def noted():
    """A list that gathers the intermediate tables written inside the block."""
    made: list[tuple[str, str | None]] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def dropped(spark: SparkSession, made: list, docs: DataFrame) -> list:
    """Delete intermediate tables but those that ``docs`` reads, which are
    returned; plans that nobody holds then let go of their shuffle files."""
    read = docs.inputFiles()
    kept = [(path, table) for path, table in made if any(path.split("/")[-1] in f for f in read)]
    for path, table in made:
        if (path, table) in kept:
            continue
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    let_go(spark)
    return kept


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nobody holds deleted: Spark's cleaner
    follows the driver's collector."""
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str):
    """64-bit identity of a document row: equal rows share it."""
    return F.xxhash64(*cols)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(c):
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def maybe_broadcast(small: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Ask for a broadcast only if the (written) frame has at most ``limit``
    rows; beyond it the join is left to the shuffle."""
    return F.broadcast(small) if small.count() <= limit else small


def slices(batches, rows: int = 500):
    """Arrow batches cut into short ones, so that a worker's Python objects stay
    small whatever the batch size of the session."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
