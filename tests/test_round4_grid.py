"""The neighbour grid in shares of subjects: same rows, scores of a share deleted."""

import os

from pyspark.sql import functions as F

from quillon.operators import evaluation as EV
from quillon.operators import neighbours as NB
from quillon.operators import ranking as R
from quillon.session import checkpoint_dir, cut_lineage


def test_shares_give_the_grid_of_all_subjects_at_once(spark, monkeypatch):
    ids = spark.range(30).select(F.col("id").alias("subject_id"))
    hist = cut_lineage(ids.filter("subject_id % 7 > 0").select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
                       .select("subject_id", F.pmod(F.xxhash64("subject_id", "i"), F.lit(40)).alias("item_id"),
                               F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("last_date"))
                       .groupBy("subject_id", "item_id").agg(F.max("last_date").alias("last_date")))
    keys = ids.select("subject_id", F.pmod("subject_id", F.lit(3)).cast("string").alias("ckey"))
    edges = cut_lineage(ids.select(F.col("subject_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank"))
                        .select("src", F.pmod(F.col("src") + F.col("rank"), F.lit(30)).alias("dst"), (F.lit(0.9) - F.col("rank") * 0.05).alias("sim"), "rank"))
    eligible, known, hidden = map(cut_lineage, R.leave_last_n_out(hist, 3))
    grid = {"sim_threshold": (0.6,), "n_similar": (3, 5), "recency_decay": (0.1,), "jaccard_weight": (0.2, 0.4)}
    seen, plain = [], EV.hidden_places
    monkeypatch.setattr(EV, "hidden_places", lambda scored, *a: seen.append(scored.select("subject_id").distinct().count()) or plain(scored, *a))
    run = lambda: sorted((r.trial, round(r.mean_auc_roc, 9), round(r.mean_auc_pr, 9), r.n_auc_subjects, r.is_best) for r in EV.neighbour_grid(
        {0.2: edges, 0.4: edges}, hist, known, hidden, eligible, keys, NB.NeighbourParams(), grid).collect())
    whole = run()
    n = seen.pop()
    assert seen == [] and len(whole) == 4 and all(r[3] > 0 for r in whole)
    monkeypatch.setattr(NB, "SHARE_ROWS", 3000)
    assert run() == whole
    assert len(seen) > 1 and sum(seen) == n
    assert not [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith(("grid-raw-", "grid-scored-"))]
