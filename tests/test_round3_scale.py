"""Findings of round 3: work that grew faster than the input, on rows made here."""
import collections

from quillon.operators import ranking as R
from quillon.plans import q_metrics as QM

SF = "/root/testdata/sf0.001"


def test_unseen_lists_read_the_ranking_only_as_far_as_needed(spark, monkeypatch):
    """No more ranks than k and the longest exclusion are read, and lists agree
    with brute force on repeated, unlisted and missing exclusions."""
    n, k = 5000, 4
    ranked = spark.range(1, n + 1).selectExpr("id + 100 AS item_id", "id AS rank", "1.0D / id AS pop")
    out = [(1, 101), (1, 101), (1, 103), (2, 5100), (3, 101), (3, 102), (3, 104), (3, 106), (3, 99999), (None, 101), (4, None)]
    subjects = spark.createDataFrame([(s,) for s in (1, 2, 3, 4, 5)], "subject_id long")
    exclude = spark.createDataFrame(out, "subject_id long, item_id long")
    read = []
    monkeypatch.setattr(R, "bounded_broadcast", lambda df: read.append(df.count()) or df)
    rows = R.top_k_excluding(ranked, subjects, exclude, k).collect()
    assert max(read) <= k + 5
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["subject_id"]].append(r["item_id"])
    assert got == {s: [i for i in range(101, 101 + n) if (s, i) not in out][:k] for s in range(1, 6)}


def test_unseen_lists_without_exclusions_or_items(spark):
    none = spark.createDataFrame([], "subject_id long, item_id long")
    subjects = spark.createDataFrame([(1,)], "subject_id long")
    ranked = spark.createDataFrame([(7, 1), (8, 2)], "item_id long, rank long")
    assert [r["item_id"] for r in R.top_k_excluding(ranked, subjects, none, 3).orderBy("rank").collect()] == [7, 8]
    held = spark.createDataFrame([(1, 7), (1, 8)], "subject_id long, item_id long")
    assert R.top_k_excluding(ranked, subjects, held, 3).count() == 0


def test_evaluations_share_one_stored_split(spark):
    """Lists of several lengths and the hidden rows no longer scan the events."""
    lists, hidden, n_items = QM.popularity_evals(spark, SF, (7, 10))
    for df in (*lists.values(), hidden):
        assert not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]
    alone, _, _ = QM.popularity_eval(spark, SF, 10)
    key = lambda df: sorted((r["subject_id"], r["rank"], r["item_id"]) for r in df.collect())
    assert key(lists[10]) == key(alone)


def test_split_keeps_subjects_with_more_items_than_hidden(spark):
    import datetime as dt
    day = lambda n: dt.date(2020, 1, n)
    rows = [(1, 1, day(1)), (1, 2, day(2)), (1, 3, day(2)), (2, 1, day(1)), (2, 2, day(2)), (None, 1, day(1)), (None, 2, day(1)), (None, 3, day(1)),
            (3, 1, None), (3, 2, day(3)), (3, 3, day(1))]
    hist = spark.createDataFrame(rows, "subject_id long, item_id long, last_date date")
    eligible, known, hidden = R.leave_last_n_out(hist, 2)
    pairs = lambda df: sorted((r["subject_id"], r["item_id"]) for r in df.collect())
    assert pairs(hidden) == [(1, 2), (1, 3), (3, 2), (3, 3)]
    assert pairs(known) == [(1, 1)]
    assert {r["subject_id"]: r["n_items"] for r in eligible.collect()} == {1: 3, 3: 3, None: 3}


def test_run_table_reads_stored_metrics(spark):
    """The run table's steps read the stored metrics, not the evaluations and the fit."""
    from quillon.plans.registry import queries
    df = queries()["model_runs"](spark, SF)
    files = df.inputFiles()
    assert files and all("run-metrics" in f for f in files)
    rows = {r["run_id"]: r for r in df.collect()}
    assert sorted(rows) == ["als-1", "pop-k10", "pop-k7"]
    assert rows["pop-k10"]["cmp_ndcg"] == rows["pop-k7"]["cmp_ndcg"] == rows["pop-k7"]["value"]


def test_cohort_items_count_subjects_once(spark, tmp_path):
    """A pair on several dates counts once and its date is in no step of the plan."""
    from quillon.plans.registry import queries
    tables = {
        "orders": ([(1, 10, "2020-01-01"), (2, 10, "2020-01-02"), (3, 11, "2020-01-03"), (4, None, "2020-01-03")],
                   "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": ([(1, 100, "2020-02-01"), (2, 100, "2020-02-02"), (2, 101, "2020-02-02"), (3, 101, "2020-02-03"), (3, None, "2020-02-03"), (4, 100, "2020-02-03")],
                     "l_orderkey long, l_partkey long, l_shipdate string"),
        "part": ([(100, "Brand#2"), (101, "Brand#9")], "p_partkey long, p_brand string")}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        for c in df.columns:
            if c.endswith("date"):
                df = df.withColumn(c, df[c].cast("timestamp"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    df = queries()["items_for_cohort"](spark, str(tmp_path))
    assert "start_date" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(100, 1), (101, 1)]
