"""Findings of round 3 on disk and time, on rows made here."""
import os
import threading

from pyspark.sql import functions as F

from quillon.operators import clean as C
from quillon.operators import models as MD
from quillon.operators import raw_files as RF
from quillon.operators import similarity as SIM
from quillon.session import checkpoint_dir


def _tables(spark, name):
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith(f"{name}-")}


def test_lists_are_shuffled_by_block_and_vectors_deleted(spark):
    """The lists of a block's shares travel as packed rows, and no vector stays
    stored once its block is."""
    vecs = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(i * (F.col("id") + 1))).alias("vec"),
                                   F.array(F.lit(1.0)).alias("jvec"))
    before = _tables(spark, "vectors")
    edges = SIM.top_k_edges(vecs, 3, 0.3, n_blocks=6)
    assert _tables(spark, "vectors") <= before
    assert "FlatMapGroupsInPandas [a_no" in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == 900


def test_tables_are_cleaned_side_by_side(spark, tmp_path, monkeypatch):
    """The jobs of two tables are under way together; their rows are reported in the given order."""
    met, one = threading.Barrier(2, timeout=60), RF.clean_and_write

    def meeting(*args):
        met.wait()
        return one(*args)

    monkeypatch.setattr(RF, "clean_and_write", meeting)
    meds = spark.createDataFrame([("2020-01-01T00:00:00Z", "1", "c"), ("2020-01-01T00:00:00Z", "1", "c"), (None, "1", "c"), ("2020-01-01T00:00:00Z", "", "c")],
                                 "START string, PATIENT string, CODE string")
    people = spark.createDataFrame([("1", "1950-01-01", "m"), ("2", "1850-01-01", "f"), ("3", None, "f")], "Id string, BIRTHDATE string, GENDER string")
    rows = RF.clean_tables(spark, {"patients": people, "medications": meds}, str(tmp_path), C.RAW_SPECS).collect()
    assert [tuple(r) for r in rows] == [("patients", 3, 1, 0, 1, 0, 1, 0), ("medications", 4, 1, 0, 1, 1, 0, 1)]
    assert spark.read.parquet(f"{tmp_path}/patients").count() == spark.read.parquet(f"{tmp_path}/medications").count() == 1


def test_grid_fits_leave_no_factors_stored(spark):
    """The packed factors of a fit are deleted once its lists are stored."""
    rows = [(u, i, 1.0) for u in range(12) for i in range(10) if (u * 7 + i * 3) % 4]
    inter = spark.createDataFrame(rows, "u int, i int, rating double")
    before = _tables(spark, "blocks")
    out = MD.als_grid_search(inter, inter.filter("(u + i) % 5 = 0"), {"rank": [2, 3], "maxIter": [7], "regParam": [0.1], "alpha": [1.0]}, k=3).collect()
    assert [r["status"] for r in out] == ["ok", "ok"] and sum(r["is_best"] for r in out) == 1
    assert _tables(spark, "blocks") <= before


def test_few_training_rows_are_few_partitions(spark, monkeypatch):
    """Each level of each tree is a job over the training partitions: their number follows the rows."""
    from pyspark.ml import Pipeline
    rows = spark.range(0, 400, 1, 40).select(F.col("id").alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    seen = []
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append(df))
    monkeypatch.setattr(MD, "TREE_ROWS", 100)
    MD.fit_gbt(rows, ["x"])
    assert seen[0].rdd.getNumPartitions() == 4 and seen[0].count() == 400
