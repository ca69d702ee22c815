"""Places of hidden items and both AUCs against listing every candidate; profiles."""
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation as EV
from quillon.operators import metrics as M
from quillon.operators import profile as PR
from quillon.plans.registry import operator_map

BLEND = 0.05


def _brute(pop, known, scored, hidden):
    """auc_roc and auc_pr of one subject by sweeping all its candidates."""
    score = {i: round(scored.get(i, BLEND * p), EV.DIGITS) for i, p in pop.items() if i not in known}
    pos, neg = [score[i] for i in hidden], [s for i, s in score.items() if i not in hidden]
    roc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if neg else None
    recall, precision, hits, area = 0.0, 1.0, 0, 0.0
    for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)), start=1):
        hits += i in hidden
        area += (hits / len(hidden) - recall) * (hits / n + precision) / 2
        recall, precision = hits / len(hidden), hits / n
    return roc, area


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(2)
    pop = {i: rnd.choice([0.1, 0.2, 0.2, 0.5, 1.0]) for i in range(40)}
    subjects = {}
    for s in range(25):
        items = rnd.sample(range(40), 40 if s == 0 else rnd.randrange(4, 30))
        hidden, known = set(items[:3]), set(items[3:])
        free = [i for i in range(40) if i not in known]
        scored = {} if s % 5 == 1 else {i: rnd.choice([0.3, 0.3, 0.6, 0.9, BLEND * 0.2]) for i in rnd.sample(free, rnd.randrange(1, len(free) + 1))}
        subjects[s] = (known, hidden, scored)
    return pop, subjects


@pytest.mark.parametrize("trials", [None, (0, 1)])
def test_auc_equals_listing_every_candidate(spark, world, trials):
    pop, subjects = world
    by = ("subject_id",) if trials is None else ("trial", "subject_id")
    lift = lambda t, x: x if t == 0 else round(1.0 - x, 6)
    runs = [(t, s) for t in trials or (0,) for s in subjects]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    scored = frame([(t, s, i, lift(t, x)) for t, s in runs for i, x in subjects[s][2].items()], "trial int, subject_id long, item_id long, score double")
    pairs = lambda k: frame([(s, i) for s, v in subjects.items() for i in v[k]], "subject_id long, item_id long")
    places = EV.hidden_places(scored, pairs(0), pairs(1), frame(list(pop.items()), "item_id long, pop double"),
                              frame(runs, "trial int, subject_id long"), BLEND, by)
    got = {(r.asDict().get("trial", 0), r.subject_id): (r.auc_roc, r.auc_pr) for r in EV.auc_per_subject(places, by).collect()}
    assert set(got) == set(runs)
    for t, s in runs:
        known, hidden, raw = subjects[s]
        roc, pr = _brute(pop, known, {i: lift(t, x) for i, x in raw.items()}, hidden)
        assert got[t, s][0] == (None if roc is None else pytest.approx(roc)) and got[t, s][1] == pytest.approx(pr)


def test_grid_has_81_trials_in_order():
    trials = EV.grid_trials()
    assert len(trials) == 81 and [t["trial"] for t in trials] == list(range(81))
    assert trials[0] == {"trial": 0, "sim_threshold": 0.5, "n_similar": 10, "recency_decay": 0.05, "jaccard_weight": 0.2}


def test_subject_without_a_list_has_no_rank_losses(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "subject_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (2, 12)], "subject_id long, item_id long")
    rows = {r.subject_id: r for r in M.per_subject(recs, truth, 7, 20).collect()}
    assert rows[2].precision == 0 and rows[2].log_loss is None and rows[2].auc_trunc is None and rows[1].auc_trunc is not None


def test_profile(spark):
    history = spark.createDataFrame([(1, 5, "2020-01-02"), (1, 6, "2021-01-01"), (1, 7, "2020-01-02")], "subject_id long, item_id long, d string").select(
        "subject_id", "item_id", F.to_date("d").alias("last_date"))
    store = spark.createDataFrame([(1, 20 + r, 0.5, r) for r in range(1, 13)], "subject_id long, item_id long, score double, rank int")
    names = spark.createDataFrame([(5, "b"), (5, "a"), (6, "c"), (21, "x")], "item_id long, description string")
    items, recs = PR.profile(history, store, names)
    assert [(r.place, r.item_id, r.item_name) for r in items.orderBy("place").collect()] == [(1, 6, "c"), (2, 7, None), (3, 5, "a")]
    assert [(r.place, r.item_name) for r in recs.orderBy("place").collect()] == [(1, "x")] + [(k, None) for k in range(2, 11)]


def test_every_operator_has_a_query():
    counts = {"S": 11, "V": 8, "P": 24, "J": 12, "A": 28, "W": 8, "T": 9, "N": 13, "D": 6, "M": 8, "E": 17}
    tagged = {o for ops in operator_map().values() for o in ops}
    assert tagged == {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)}
