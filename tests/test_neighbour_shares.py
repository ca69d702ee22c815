"""Neighbour lists made in shares of subjects: same lists, nothing left behind."""

import os

from pyspark.sql import functions as F

from quillon.operators import neighbours as NB
from quillon.operators import ranking as R
from quillon.session import checkpoint_dir, cut_lineage


def _inputs(spark):
    ids = spark.range(40).select(F.col("id").alias("subject_id"))
    hist = (ids.filter("subject_id % 7 > 0").select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
            .select("subject_id", F.pmod(F.xxhash64("subject_id", "i"), F.lit(60)).alias("item_id"),
                    F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("last_date"))
            .groupBy("subject_id", "item_id").agg(F.max("last_date").alias("last_date")))
    keys = ids.filter("subject_id < 38").select("subject_id", F.pmod("subject_id", F.lit(3)).cast("string").alias("ckey"))
    edges = (ids.select(F.col("subject_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(22))).alias("rank"))
             .select("src", F.pmod(F.col("src") + F.col("rank"), F.lit(40)).alias("dst"), (F.lit(0.9) - F.col("rank") * 0.02).alias("sim"), "rank"))
    return ids, cut_lineage(edges), cut_lineage(hist), cut_lineage(keys)


def _rows(df):
    return sorted((r.subject_id, r.rank, r.item_id, round(r.score, 9), r.source) for r in df.collect())


def test_shares_give_the_lists_of_all_subjects_at_once(spark, monkeypatch):
    ids, edges, hist, keys = _inputs(spark)
    p = NB.NeighbourParams()
    pop = cut_lineage(NB.item_popularity(hist, keys))
    raw = NB.raw_scores(ids, edges, hist, hist, keys, p, hist)
    plain = _rows(NB.ranked_lists(NB.calibrate(raw, pop, p), pop, ids, hist, p))
    monkeypatch.setattr(NB, "SHARE_ROWS", 2000)
    monkeypatch.setattr(NB, "PACK_ITEMS", 5)
    assert _rows(NB.recommend(ids, edges, hist, hist, keys, p)) == plain
    folder = checkpoint_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith(("raw-", "packed-", "recency-", "neighbours-", "idf-"))]


def test_candidates_are_dealt_packed(spark):
    """The edges' items meet known ones and each other behind one shuffle."""
    _, edges, hist, keys = _inputs(spark)
    p = NB.NeighbourParams()
    recency = cut_lineage(R.recency_rank(hist).select("subject_id", "item_id", "recency"))
    neigh = cut_lineage(NB.select_neighbours(edges, p))
    w = NB.packed_weights(neigh, cut_lineage(NB.packed_history(recency)), hist, p)
    plan = w._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate inline") < plan.index("REPARTITION_BY_COL")
    known = {(r.subject_id, r.item_id) for r in hist.collect()}
    got = {(r.subject_id, r.item_id): r._w for r in w.collect()}
    want = {}
    items = {}
    for r in recency.collect():
        items.setdefault(r.subject_id, []).append((r.item_id, r.recency))
    for e in neigh.collect():
        for item, age in items.get(e.dst, []):
            if (e.src, item) not in known:
                want[e.src, item] = want.get((e.src, item), 0.0) + e.sim ** p.conf_exp * (1 - p.recency_decay) ** age
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
