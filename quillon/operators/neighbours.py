"""Neighbour recommender.

Inputs are DataFrames: top-k similarity edges, per-subject item history and
the subjects' cohort keys.  Every step is a join or an aggregate keyed on
(subject) or (subject, item); per-subject normalisations (L1, min-max) are
aggregates joined back rather than windows, so a hot subject is reduced
map-side.  Unscored candidates are never enumerated: their score depends only
on item popularity, so the best of them come from one global popularity
ranking (``ranking.top_k_excluding``).
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import model_store as MS
from quillon.operators import ranking as R
from quillon.session import cut_lineage, discard, stored


@dataclass(frozen=True)
class NeighbourParams:
    # Fixed defaults of the reference neighbour model.
    top_k: int = 7
    n_similar: int = 15
    sim_threshold: float = 0.60
    score_threshold: float = 0.0
    recency_decay: float = 0.10
    conf_exp: float = 2.0
    bm25_k1: float = 1.2
    baseline_blend: float = 0.05
    sigmoid_gain: float = 6.0
    sigmoid_sharpen: bool = True
    min_known: int = 1

    @property
    def cap(self) -> int:
        return int(self.n_similar * 1.5)

    @property
    def edge_k(self) -> int:
        return max(self.n_similar, self.cap)


DEFAULT_IDF = math.log1p(1.0)  # ln 2 for items missing from the lookup
# Items of a neighbour that one packed row lists, and candidates (edges x items of
# the neighbour) that are scored together; beyond MAX_SHARES shares grow instead.
PACK_ITEMS, SHARE_ROWS, MAX_SHARES = 4096, 1 << 25, 64


def item_history(item_events: DataFrame) -> DataFrame:
    """(subject, item, last_date = max(start_date))."""
    return item_events.groupBy("subject_id", "item_id").agg(F.max("start_date").alias("last_date"))


def cohort_keys(features: DataFrame, flag_cols) -> DataFrame:
    """The subject's flags joined by '|'."""
    return features.select("subject_id", F.concat_ws(
        "|", *[F.col(c).cast("int").cast("string") for c in flag_cols]).alias("ckey"))


def cohort_idf(keys: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """idf_C(m) = ln(1 + |C with history| / (1 + |C holding m|)); global uses all subjects.

    Returns (cohort idf (ckey, item_id, idf), cohort sizes (ckey, size),
    global idf (item_id, gidf)).  A cohort key held by a third of all
    subjects is fine: every step is a partial-aggregated group-by.
    """
    h = history.select("subject_id", "item_id").join(keys, "subject_id")  # J4: known subjects only
    sizes = h.select("ckey", "subject_id").distinct().groupBy("ckey").agg(F.count(F.lit(1)).alias("size"))
    cnt = h.groupBy("ckey", "item_id").agg(F.count(F.lit(1)).alias("cnt"))
    idf = (cnt.join(sizes, "ckey")
           .select("ckey", "item_id", F.log1p(F.col("size") / (F.col("cnt") + 1.0)).alias("idf")))
    total = keys.agg(F.count(F.lit(1))).scalar()
    g = (h.groupBy("item_id").agg(F.count(F.lit(1)).alias("gcnt"))
         .select("item_id", F.log1p(total / (F.col("gcnt") + 1.0)).alias("gidf")))
    return idf, sizes, g


def item_popularity(history: DataFrame, subjects: DataFrame) -> DataFrame:
    """Universe of items with freq (# subjects holding it) and pop = freq / max freq."""
    h = history.join(subjects.select("subject_id"), "subject_id", "left_semi")
    freq = h.groupBy("item_id").agg(F.count(F.lit(1)).alias("freq"))
    mx = freq.agg(F.max("freq").cast("double")).scalar()
    return freq.withColumn("pop", F.col("freq") / mx)


def select_neighbours(edges: DataFrame, p: NeighbourParams) -> DataFrame:
    """Neighbours with sim >= threshold, capped at int(1.5 n); fewer than 3 -> plain top-n.

    ``edges`` must hold each src's best ``p.edge_k`` partners with ``rank``.
    """
    n_above = (edges.filter(F.col("sim") >= p.sim_threshold)
               .groupBy("src").agg(F.count(F.lit(1)).alias("n_above")))
    e = edges.join(n_above, "src", "left").fillna(0, subset=["n_above"])
    keep = (F.when(F.col("n_above") < 3, F.col("rank") <= p.n_similar)
             .otherwise((F.col("sim") >= p.sim_threshold) & (F.col("rank") <= p.cap)))
    return e.filter(keep).select("src", "dst", "sim")


def score_candidates(neigh: DataFrame, hist_recency: DataFrame, known: DataFrame,
                     keys: DataFrame, idf: DataFrame, sizes: DataFrame, gidf: DataFrame,
                     p: NeighbourParams) -> DataFrame:
    """N5 + N6 + J5: raw score per (subject, unseen item).

    sum over neighbours of sim^conf_exp * (1 - decay)^recency, times the
    subject's cohort idf (or global idf when the cohort has no history;
    ln 2 when the item is missing) times BM25 tf (tf = 1 -> 1.0).
    """
    nh = hist_recency.select(F.col("subject_id").alias("dst"), "item_id", "recency")
    c = (neigh.join(nh, "dst")
         .withColumnRenamed("src", "subject_id")
         .join(known.select("subject_id", "item_id"), ["subject_id", "item_id"], "left_anti")
         .groupBy("subject_id", "item_id")
         .agg(F.sum(F.pow(F.col("sim"), F.lit(p.conf_exp))
                    * F.pow(F.lit(1.0 - p.recency_decay), F.col("recency"))).alias("_w")))
    return raw_of(c, keys, idf, sizes, gidf, p)


def raw_of(weights: DataFrame, keys: DataFrame, idf: DataFrame, sizes: DataFrame, gidf: DataFrame, p: NeighbourParams) -> DataFrame:
    """Raw score of (subject, item, _w) rows."""
    tf = 1.0
    bm25 = tf * (p.bm25_k1 + 1.0) / (tf + p.bm25_k1)
    return (with_idf(weights, keys, idf, sizes, gidf)
            .select("subject_id", "item_id", (F.col("_w") * F.col("idf_value") * F.lit(bm25)).alias("raw")))


def with_idf(pairs: DataFrame, keys: DataFrame, idf: DataFrame, sizes: DataFrame, gidf: DataFrame) -> DataFrame:
    """J11 lookups: subject -> cohort key, (key, item) -> idf, item -> global idf,
    as column ``idf_value`` of (subject, item, ...) rows."""
    # Cohorts without history have no (key, item) row; their subjects look up the
    # item alone, as rows of a null key, so that the pairs are shuffled once for both.
    of = keys.join(sizes.select("ckey", F.lit(True).alias("_has_cohort")), "ckey", "left").select(
        "subject_id", F.when(F.col("_has_cohort"), F.col("ckey")).alias("ckey"))
    look = (idf.filter("ckey is not null").select(F.col("ckey").alias("_k"), F.col("item_id").alias("_i"), F.col("idf").alias("_idf"))
            .union(gidf.select(F.lit(None).cast("string"), "item_id", "gidf")))
    c = pairs.join(of, "subject_id", "left")
    c = c.join(look, F.col("ckey").eqNullSafe(F.col("_k")) & (F.col("item_id") == F.col("_i")), "left")
    return c.select(*pairs.columns, F.coalesce("_idf", F.lit(DEFAULT_IDF)).alias("idf_value"))


def sigmoid(x, gain: float) -> F.Column:
    """1 / (1 + exp(-gain (x - 0.5)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-gain) * (x - F.lit(0.5))))


def calibrate(raw: DataFrame, pop: DataFrame, p: NeighbourParams, by: tuple = ("subject_id",)) -> DataFrame:
    """N7 L1 -> N8 min-max (all equal -> 0.5) -> N9 sigmoid -> N10 blend with popularity.

    One aggregate serves both normalisations: the L1 total is positive or
    leaves the scores as they are, so it moves no minimum or maximum.  ``by``
    names what is normalised together (a subject, or a trial and a subject).
    """
    by = list(by)
    stats = raw.groupBy(*by).agg(F.sum("raw").alias("_tot"), F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    per = F.when(F.col("_tot") > 0, F.col("_tot")).otherwise(F.lit(1.0))
    l1, lo, hi = F.col("raw") / per, F.col("_lo") / per, F.col("_hi") / per
    mm = F.when(hi == lo, F.lit(0.5)).otherwise((l1 - lo) / (hi - lo))
    cal = sigmoid(mm, p.sigmoid_gain) if p.sigmoid_sharpen else mm
    a = p.baseline_blend
    return (raw.join(stats, by).join(pop.select("item_id", "pop"), "item_id", "left")
            .select(*by, "item_id",
                    ((1.0 - a) * cal + a * F.coalesce(F.col("pop"), F.lit(0.0))).alias("score")))


def apply_score_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    """Keep scores > threshold unless that would leave the subject nothing."""
    if threshold <= 0.0:
        return scores
    n_pass = (scores.filter(F.col("score") > threshold).groupBy("subject_id")
              .agg(F.count(F.lit(1)).alias("_np")))
    s = scores.join(n_pass, "subject_id", "left").fillna(0, subset=["_np"])
    return s.filter((F.col("_np") == 0) | (F.col("score") > threshold)).drop("_np")


def recommend(subjects: DataFrame, edges: DataFrame, history: DataFrame, known: DataFrame,
              keys: DataFrame, p: NeighbourParams, pop_rank: DataFrame | None = None,
              fit_history: DataFrame | None = None) -> DataFrame:
    """Top-K recommendations per subject: (subject_id, rank, item_id, score, source).

    ``history`` = neighbours' histories (with dates), ``known`` = each target
    subject's known items.  Subjects with fewer than ``min_known`` known items
    or no scored candidate fall back to popularity (N11).
    """
    fit = fit_history if fit_history is not None else history
    pop = cut_lineage(item_popularity(fit, keys))
    best = best_scored(subjects, edges, history, known, keys, pop, p, fit)
    return completed_lists(best, pop, subjects, known, p, pop_rank)


def warm_neighbours(subjects: DataFrame, edges: DataFrame, known: DataFrame, p: NeighbourParams) -> DataFrame:
    """The selected neighbours of the subjects with enough known items."""
    n_known = known.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_known"))
    warm = (subjects.select("subject_id").join(n_known, "subject_id", "left")
            .filter(F.coalesce(F.col("n_known"), F.lit(0)) >= p.min_known).select("subject_id"))
    return select_neighbours(edges.join(warm.withColumnRenamed("subject_id", "src"), "src", "left_semi"), p)


def packed_history(hist_recency: DataFrame) -> DataFrame:
    """(subject_id, items): at most ``PACK_ITEMS`` (item_id, recency) of a subject a row."""
    chunk = F.floor(F.col("recency") / PACK_ITEMS)
    return (hist_recency.groupBy("subject_id", chunk.alias("chunk"))
            .agg(F.collect_list(F.struct("item_id", "recency")).alias("items")).select("subject_id", "items"))


def packed_weights(neigh: DataFrame, packed: DataFrame, known: DataFrame, p: NeighbourParams) -> DataFrame:
    """N5 + J5: (subject, unseen item, _w).  The neighbours' items and the known
    ones are dealt by subject as packed rows and unpacked behind that shuffle."""
    offers = (neigh.join(packed.withColumnRenamed("subject_id", "dst"), "dst")
              .select(F.col("src").alias("subject_id"), F.pow(F.col("sim"), F.lit(p.conf_exp)).alias("_s"), F.lit(False).alias("_held"), "items"))
    # A null item equals none, so it excludes none.
    held = (known.filter("item_id is not null").join(neigh.select(F.col("src").alias("subject_id")).distinct(), "subject_id", "left_semi")
            .groupBy("subject_id", F.pmod(F.xxhash64("item_id"), F.lit(16)).alias("chunk"))
            .agg(F.collect_list(F.struct("item_id", F.lit(0).alias("recency"))).alias("items"))
            .select("subject_id", F.lit(0.0).alias("_s"), F.lit(True).alias("_held"), "items"))
    return (offers.union(held).repartition("subject_id").select("subject_id", "_s", "_held", F.inline("items"))
            .groupBy("subject_id", "item_id")
            .agg(F.sum(F.col("_s") * F.pow(F.lit(1.0 - p.recency_decay), F.col("recency"))).alias("_w"), F.bool_or("_held").alias("_held"))
            .filter("not _held").select("subject_id", "item_id", "_w"))


def best_scored(subjects: DataFrame, edges: DataFrame, history: DataFrame, known: DataFrame, keys: DataFrame,
                pop: DataFrame, p: NeighbourParams, fit: DataFrame) -> DataFrame:
    """(subject_id, item_id, score): each subject's ``p.top_k`` best calibrated scores.

    Scores and calibration of a subject need its own candidates alone, so subjects
    are taken in shares of about ``SHARE_ROWS`` candidates; a share's tables and
    shuffle files are deleted before the next one, and only the lists stay."""
    hist = stored(R.recency_rank(history.join(keys.select("subject_id"), "subject_id", "left_semi")).select("subject_id", "item_id", "recency"), "recency")
    packed = stored(packed_history(hist), "packed")
    neigh = stored(warm_neighbours(subjects, edges, known, p), "neighbours")
    # The lookups are stored as well: every share reads them.
    idf, sizes, gidf = (stored(x, "idf") for x in cohort_idf(keys, fit))
    n_items = packed.groupBy(F.col("subject_id").alias("dst")).agg(F.sum(F.size("items")).alias("n"))
    n = neigh.join(n_items, "dst").agg(F.sum("n")).first()[0] or 0
    shares = min(MAX_SHARES, max(1, -(-n // SHARE_ROWS)))
    discard(hist, "recency")
    parts = []
    for i in range(shares):
        own = neigh.filter(F.pmod(F.xxhash64("src"), F.lit(shares)) == i) if shares > 1 else neigh
        weights = packed_weights(own, packed, known, p)
        raw = stored(raw_of(weights, keys, idf, sizes, gidf, p), "raw")
        parts.append(stored(R.top_k(calibrate(raw, pop, p), p.top_k).select("subject_id", "item_id", "score"), "best"))
        discard(raw, "raw")
    for x, name in ((packed, "packed"), (neigh, "neighbours"), (idf, "idf"), (sizes, "idf"), (gidf, "idf")):
        discard(x, name)
    return reduce(DataFrame.union, parts)


def raw_scores(subjects: DataFrame, edges: DataFrame, history: DataFrame, known: DataFrame, keys: DataFrame,
               p: NeighbourParams, fit: DataFrame) -> DataFrame:
    """Raw scores of the subjects with enough known items, computed once (the
    calibration reads them twice)."""
    hist_r = R.recency_rank(history.join(keys.select("subject_id"), "subject_id", "left_semi"))
    idf, sizes, gidf = cohort_idf(keys, fit)
    neigh = warm_neighbours(subjects, edges, known, p)
    return cut_lineage(score_candidates(neigh, hist_r, known, keys, idf, sizes, gidf, p))


def ranked_lists(scored: DataFrame, pop: DataFrame, subjects: DataFrame, known: DataFrame, p: NeighbourParams,
                 pop_rank: DataFrame | None = None) -> DataFrame:
    """The best ``p.top_k`` of calibrated scores and popularity per subject."""
    best = cut_lineage(R.top_k(scored, p.top_k).select("subject_id", "item_id", "score"))
    return completed_lists(best, pop, subjects, known, p, pop_rank)


def completed_lists(best: DataFrame, pop: DataFrame, subjects: DataFrame, known: DataFrame, p: NeighbourParams,
                    pop_rank: DataFrame | None = None) -> DataFrame:
    """The best ``p.top_k`` per subject of its best calibrated scores and popularity."""
    if pop_rank is None:
        pop_rank = R.global_rank(pop, [F.col("freq").desc(), F.col("item_id").asc()])
    # The best unseen items by popularity complete the list.  A calibrated score
    # is at least blend * pop, so the k best scored and the k most popular
    # unseen items hold the k best of all, an item in both with its larger score.
    scored_subj = best.select("subject_id", F.lit(True).alias("warm")).distinct()
    fill = (R.top_k_excluding(pop_rank, subjects, known, p.top_k).join(scored_subj, "subject_id", "left")
            .withColumn("warm", F.coalesce("warm", F.lit(False))))
    fill = fill.select("subject_id", "item_id",
                       F.when(F.col("warm"), F.lit(p.baseline_blend) * F.col("pop")).otherwise(F.col("pop")).alias("score"), "warm")
    every = (best.withColumn("warm", F.lit(True)).unionByName(fill)
             .groupBy("subject_id", "item_id", "warm").agg(F.max("score").alias("score")))
    # Subjects without a scored item get popularity, unblended.
    source = F.when(F.col("warm"), F.lit("neighbours")).otherwise(F.lit("popularity"))
    top = R.top_k(every, p.top_k)
    if p.score_threshold > 0.0:
        top = apply_score_threshold(top.filter("warm"), p.score_threshold).unionByName(top.filter("not warm"))
    return top.select("subject_id", "rank", "item_id", "score", source.alias("source"))


def save_artefacts(spark, folder: str, version: str, edges: DataFrame, keys: DataFrame, history: DataFrame, p: NeighbourParams) -> None:
    """The fitted model as tables and its parameters."""
    MS.save(spark, folder, "neighbours", version, tables={"edges": edges, "cohort_keys": keys, "history": history}, params=asdict(p))


def load_artefacts(spark, folder: str, version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, NeighbourParams]:
    """(edges, cohort keys, history, parameters) of a saved version, the newest by default."""
    saved = MS.load(spark, folder, "neighbours", version)
    return saved.tables["edges"], saved.tables["cohort_keys"], saved.tables["history"], NeighbourParams(**saved.params)
