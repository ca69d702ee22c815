"""Hand-computed cases and properties for the formulas (FIXTURES §4)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import encode as E
from quillon.functions import vectors as V
from quillon.operators import clean as C
from quillon.operators import metrics as M
from quillon.operators import neighbours as NB
from quillon.operators import ranking as R
from quillon.operators import similarity as SIM
from quillon.operators import store as ST


def one(df):
    return df.collect()[0]


def test_sigmoid(spark):
    r = one(spark.range(1).select(NB.sigmoid(F.lit(0.7), 6.0).alias("s")))
    assert round(r.s, 6) == 0.768525


def _recs(spark):
    recs = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3)], "subject_id long, item_id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "b")], "subject_id long, item_id string")
    return recs, truth


def test_ranking_metrics_hand_case(spark):
    recs, truth = _recs(spark)
    r = one(M.per_subject(recs, truth, 3, 10))
    assert round(r.ndcg, 6) == 0.693426
    assert round(r.ap, 6) == 0.583333
    assert r.rr == 0.5
    assert round(r.auc_trunc, 6) == 0.875
    assert round(r.precision, 6) == round(2 / 3, 6) and r.recall == 1.0


def test_minmax_all_equal(spark):
    raw = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "subject_id long, item_id string, raw double")
    pop = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "item_id string, pop double")
    p = NB.NeighbourParams(sigmoid_sharpen=False, baseline_blend=0.0)
    vals = {r.item_id: r.score for r in NB.calibrate(raw, pop, p).collect()}
    assert vals == {"a": 0.5, "b": 0.5}


def test_rmse_score(spark):
    r = one(spark.range(1).select(M.normalised_score(F.lit("rmse"), F.lit(1.0)).alias("s"),
                                  M.normalised_score(F.lit("auc"), F.lit(None).cast("double")).alias("m")))
    assert r.s == 0.5 and r.m == -1.0


def test_unknown_category_and_binary(spark):
    df = spark.createDataFrame([("other", "M"), (None, "F"), ("White", "M")], "race string, gender string")
    out = df.select(E.category_code("race", {"white": 0, "black": 1, "asian": 2, "native": 3, "hispanic": 4}, 5).alias("c"),
                    E.binary_code("gender", "M").alias("g")).collect()
    assert [(r.c, r.g) for r in out] == [(5, 1), (5, 0), (0, 1)]


def test_zero_vector_fallback(spark):
    r = one(spark.range(1).select(V.smooth_l2_normalize(F.array(*[F.lit(0.0)] * 4)).alias("v")))
    assert [round(x, 6) for x in r.v] == [0.5] * 4
    e = one(spark.range(1).select(V.smooth_l2_normalize(F.array().cast("array<double>")).alias("v")))
    assert e.v == []


def test_cleaning_cases(spark):
    cols = [c.source for c in C.CODE_EVENTS.columns]
    rows = [
        ("2020-01-01", "", "p1", "e1", "c1", "d"),          # ok, open stop -> null
        ("2020-01-01", "", "p1", "e2", "c1", "d"),          # duplicate key -> one row kept
        ("2020-01-01", "", "", "e3", "c1", "d"),            # blank id -> dropped
        ("not-a-date", "", "p2", "e4", "c1", "d"),          # bad date -> dropped by the floor filter
        ("1890-01-01", "", "p3", "e5", "c1", "d"),          # before 1900 -> dropped
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    out = C.clean(raw, C.CODE_EVENTS).collect()
    assert len(out) == 1
    assert out[0].stop_date is None and out[0].encounter_id == "e1"
    reasons = [r.r for r in raw.select(C.reject_reason(raw, C.CODE_EVENTS).alias("r")).collect()]
    assert reasons == [None, None, "empty", "floor", "floor"]


def test_recency_rank_matches_window(spark):
    from pyspark.sql import Window
    rng = np.random.default_rng(1)
    rows = [(int(s), int(i), int(d)) for s, i, d in zip(rng.integers(0, 5, 300), rng.integers(0, 40, 300),
                                                         rng.integers(0, 6, 300))]
    h = spark.createDataFrame(rows, "subject_id long, item_id long, d int").dropDuplicates(["subject_id", "item_id"]) \
        .withColumn("last_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    ours = {(r.subject_id, r.item_id): r.recency for r in R.recency_rank(h).collect()}
    w = Window.partitionBy("subject_id").orderBy(F.col("last_date").desc(), F.col("item_id").desc())
    ref = {(r.subject_id, r.item_id): r.rk - 1 for r in h.withColumn("rk", F.row_number().over(w)).collect()}
    assert ours == ref


def test_global_rank_and_prefix_sums(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    r = R.global_rank(df, [F.col("k").asc()], "rk").collect()
    assert sorted(x.rk for x in r) == list(range(1, 1001))
    assert all(x.rk == x.k + 1 for x in r)
    p = R.prefix_sums(df.withColumn("one", F.lit(1)), [F.col("k").asc()], ["one", "k"]).collect()
    assert all(x.cum_one == x.k + 1 and x.cum_k == x.k * (x.k + 1) // 2 for x in p)


def test_top_k_excluding_brute_force(spark):
    items = spark.createDataFrame([(i, 100 - i) for i in range(30)], "item_id long, freq long")
    ranked = R.global_rank(items, [F.col("freq").desc(), F.col("item_id").asc()])
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    excl = spark.createDataFrame([(1, 0), (1, 1), (1, 5), (2, 3)] + [(3, i) for i in range(25)],
                                 "subject_id long, item_id long")
    got = {}
    for r in R.top_k_excluding(ranked, subjects, excl, 4).collect():
        got.setdefault(r.subject_id, []).append((r.rank, r.item_id))
    got = {s: [i for _, i in sorted(v)] for s, v in got.items()}
    assert got == {1: [2, 3, 4, 6], 2: [0, 1, 2, 4], 3: [25, 26, 27, 28]}


def test_top_k_excluding_with_a_hot_subject(spark):
    """One subject excludes most of a list that spans several rank buckets,
    with repeats and items outside the list."""
    n = 3 * R.RANK_BUCKET
    ranked = spark.range(n).select(F.col("id").alias("item_id"), (F.col("id") + 1).alias("rank"))
    open_ranks = [1500, 1501, n - 1, n]
    hot = spark.range(n).filter(~F.col("id").isin([r - 1 for r in open_ranks])).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("item_id"))
    excl = hot.union(hot.limit(50)).union(spark.createDataFrame([(1, n + 7), (2, 0)], "subject_id long, item_id long"))
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    got = {}
    for r in R.top_k_excluding(ranked, subjects, excl, 5).collect():
        got.setdefault(r.subject_id, []).append(r["rank"])
    assert {s: sorted(v) for s, v in got.items()} == {1: open_ranks, 2: [2, 3, 4, 5, 6], 3: [1, 2, 3, 4, 5]}


def test_similarity_kernel_brute_force(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vecs = emb.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
                      F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("jvec"))
    pdf = vecs.toPandas()
    X = np.stack(pdf.vec.to_numpy())
    J = np.stack(pdf.jvec.to_numpy())
    ids = pdf.id.to_numpy()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    inter = J @ J.T
    S = 0.7 * (Xn @ Xn.T) + 0.3 * inter / np.maximum(J.sum(1)[:, None] + J.sum(1)[None, :] - inter, 1e-9)
    S = np.clip(S, 0, 1)
    np.fill_diagonal(S, -1)
    k = 5
    for blocks in (1, 3):
        got = SIM.top_k_edges(vecs, k, 0.3, n_blocks=blocks).collect()
        by = {}
        for r in got:
            by.setdefault(r.src, []).append((r.rank, r.dst, r.sim))
        for i, s in enumerate(ids[:50]):
            row = S[i]
            order = sorted(range(len(ids)), key=lambda j: (-round(row[j], 9), ids[j]))[:k]
            exp = [int(ids[j]) for j in order]
            assert [d for _, d, _ in sorted(by[int(s)])] == exp
    # symmetry of the similarity values
    e = {(r.src, r.dst): r.sim for r in got}
    for (a, b), v in e.items():
        if (b, a) in e:
            assert abs(e[(b, a)] - v) < 1e-9


def test_binary_metrics_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)  # ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, p1 double")
    r = one(M.binary_metrics(df))
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(r.auc_roc - auc) < 1e-12
    # average precision over distinct thresholds
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        ap += ((y == 1) & (s == t)).sum() / (y == 1).sum() * (y[sel] == 1).sum() / sel.sum()
    assert abs(r.average_precision - ap) < 1e-12


def test_store_replace_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "subject_id long, rank int, item_id string")
    new = spark.createDataFrame([(2, 1, "c")], "subject_id long, rank int, item_id string")
    once = ST.replace_subjects(old, new)
    twice = ST.replace_subjects(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1, "a"), (2, 1, "c")]


def test_hash_split_stable_under_repartition(spark):
    from quillon.operators import models as MD
    df = spark.range(2000).withColumnRenamed("id", "k")
    a, _ = MD.hash_split(df, ["k"])
    b, _ = MD.hash_split(df.repartition(13), ["k"])
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())


def test_write_store_keeps_other_subjects(spark, tmp_path):
    from quillon.operators import store as ST
    path = str(tmp_path / "store")
    rows = [(s, r, f"i{s}{r}", 0.5) for s in range(200) for r in (1, 2)]
    schema = "subject_id long, rank int, item_id string, score double"
    ST.write_store(spark.createDataFrame(rows, schema), path, buckets=4)
    ST.write_store(spark.createDataFrame([(7, 1, "new", 0.9)], schema), path, buckets=64)
    got = spark.read.parquet(path)
    assert got.count() == 399
    assert [tuple(r)[:2] for r in ST.read_for_subject(got, 7).select("item_id", "rank").collect()] == [("new", 1)]
    assert got.select("subject_bucket").distinct().count() == 4


def test_whole_reports(spark):
    from quillon.plans.registry import queries
    sf = "/root/testdata/sf0.001"
    assert {r.table_name for r in queries()["clean_report_all"](spark, sf).collect()} == {
        "conditions", "encounters", "medications", "observations", "patients"}
    stats = queries()["code_vector_stats"](spark, sf).collect()
    assert {r.vector for r in stats} == {"code", "item"}
    assert all(0 < r.nz_mean <= r.nz_max <= 50 and r.mean > 0 for r in stats if r.vector == "item")
    runs = {r.run_id: r for r in queries()["model_runs"](spark, sf).collect()}
    als = runs["als-1"]
    assert set(runs) == {"als-1", "pop-k7", "pop-k10"} and als.metric == "rmse" and als.value > 0
    assert als.cmp_rmse == als.value and abs(als.score - 1 / (1 + als.value)) < 1e-12


def _edge_rows(vecs, k, w, **kw):
    return sorted((r.src, r["rank"], r.dst, round(r.sim, 9)) for r in SIM.top_k_edges(vecs, k, w, **kw).collect())


@pytest.mark.parametrize("w", [0.0, 0.3])
def test_edges_of_copies_and_repeated_ids(spark, monkeypatch, w):
    """Classes of equal vectors, ids that occur twice, and a share a block: the
    lists of comparing all rows with all rows."""
    from quillon.operators import blocks as BL
    rng = np.random.default_rng(5)
    X, J = rng.random((60, 6)) - 0.3, rng.random((60, 4))
    X[:3] = 0
    rows = [(3 * i, X[i].tolist(), J[i].tolist()) for i in range(60)]
    rows += [(1000 + c, X[5].tolist(), J[5].tolist()) for c in range(20)] + rows[20:24] + [(30, X[7].tolist(), J[7].tolist())] * 2
    vecs, k = spark.createDataFrame(rows, "id long, vec array<double>, jvec array<double>"), 5
    want = []
    for src in {r[0] for r in rows}:
        found = []
        for a in (r for r in rows if r[0] == src):
            for b in rows:
                if b[0] != src:
                    va, vb, ja, jb = map(np.array, (a[1], b[1], a[2], b[2]))
                    n = (np.linalg.norm(va) or 1.0) * (np.linalg.norm(vb) or 1.0)
                    s = (1 - w) * (va @ vb / n) + w * (ja @ jb) / max(ja.sum() + jb.sum() - ja @ jb, 1e-9)
                    found.append((-round(min(max(s, 0.0), 1.0), 9), b[0]))
        want += [(src, p + 1, dst, -s) for p, (s, dst) in enumerate(sorted(found)[:k])]
    for share in (1 << 30, 600):
        monkeypatch.setattr(BL, "SHARE_BYTES", share)
        got = _edge_rows(vecs, k, w, n_blocks=3, block_rows=8)
        assert [g[:3] for g in got] == [x[:3] for x in sorted(want)]
        assert np.allclose([g[3] for g in got], [x[3] for x in sorted(want)], atol=1e-8)


def test_vectors_are_not_replicated_by_block(spark):
    """Each vector is shuffled once, not once for every block it is compared with."""
    vecs = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(i * (F.col("id") + 1))).alias("vec"),
                                   F.array(F.lit(1.0)).alias("jvec"))
    plan = SIM.top_k_edges(vecs, 3, n_blocks=20, block_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence(0" not in plan
