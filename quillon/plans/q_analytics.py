"""Population analytics, data quality and recommendation-store queries
(A8, A10-A28, P14, P16-P23, J7-J9, V5-V9, S7, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import encode as E
from quillon.functions.text import explanation
from quillon.operators import neighbours as NB
from quillon.operators import profile as PR
from quillon.operators import ranking as R
from quillon.operators import store as ST
from quillon.operators.quantiles import exact_quantiles
from quillon.plans import binding as B
from quillon.plans.q_features import (FRAG_CODE_HELD, FRAG_CODE_VOCAB, FRAG_FEAT, FRAG_VECTORS, FRAG_VOCAB, SPEC,
                                      feature_frame, scalar_frame, with_sql)
from quillon.plans.registry import query
from quillon.session import stored
from quillon.sources.tables import TABLES

FLAGS = [g[0] for g in B.FLAG_GROUPS]
PHRASES = [(g[0], g[2]) for g in B.FLAG_GROUPS]
TOTAL_SUBJECTS_SQL = "(SELECT count(*) FROM customer)"


def _total(spark, d):
    return B.frames(spark, d).subjects().agg(F.count(F.lit(1))).scalar()


def r6(c):
    return F.round(c, 6) if not isinstance(c, str) else F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------- interactions
@query("distinct_interactions", ops=("A8",), sql=with_sql() + """
SELECT DISTINCT subject_id, item_id, 1.0 AS rating FROM item_events""")
def q_distinct_interactions(spark, d):
    return (B.frames(spark, d).item_events().select("subject_id", "item_id").distinct()
            .withColumn("rating", F.lit(1.0)))


@query("item_catalogue", ops=("A10", "A5"), sql=with_sql() + """
SELECT e.item_id, min(p.p_name) AS item_name, count(DISTINCT e.subject_id) AS subject_count
FROM item_events e JOIN part p ON p.p_partkey = e.item_id GROUP BY e.item_id""")
def q_item_catalogue(spark, d):
    """Counted per item first; names join one row an item, not every event."""
    f = B.frames(spark, d)
    counts = f.item_events().groupBy("item_id").agg(F.count_distinct("subject_id").alias("subject_count"))
    names = f.item_names().groupBy("item_id").agg(F.min("description").alias("item_name"))
    return counts.join(names, "item_id").select("item_id", "item_name", "subject_count")


@query("item_prevalence", ops=("A11", "A5"), sql=with_sql() + f"""
SELECT item_id, round(count(DISTINCT subject_id) / {TOTAL_SUBJECTS_SQL}, 6) AS prevalence FROM item_events GROUP BY 1""")
def q_item_prevalence(spark, d):
    f = B.frames(spark, d)
    return (f.item_events().groupBy("item_id")
            .agg(r6(F.count_distinct("subject_id") / _total(spark, d)).alias("prevalence")))


# ---------------------------------------------------------------- population
@query("population_stats", ops=("A12",), sql=with_sql(FRAG_FEAT) + f"""
SELECT count(*) AS total, {", ".join(f"CAST(sum({c}) AS BIGINT) AS n_{c}" for c in FLAGS)},
       round(avg(age), 1) AS avg_age, min(age) AS min_age, max(age) AS max_age FROM feat""")
def q_population_stats(spark, d):
    f = scalar_frame(spark, d)
    return f.agg(F.count(F.lit(1)).alias("total"), *[F.sum(c).cast("long").alias(f"n_{c}") for c in FLAGS],
                 F.round(F.avg("age"), 1).alias("avg_age"), F.min("age").alias("min_age"),
                 F.max("age").alias("max_age"))


@query("flag_prevalence", ops=("A13",), sql=with_sql(FRAG_FEAT) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS flag, round(sum({c}) * 100.0 / count(*), 6) AS pct FROM feat" for c in FLAGS))
def q_flag_prevalence(spark, d):
    f = scalar_frame(spark, d)
    row = f.agg(*[(F.sum(c) * 100.0 / F.count(F.lit(1))).alias(c) for c in FLAGS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("pct")) for c in FLAGS]))
                      .alias("x")).select("x.flag", r6(F.col("x.pct")).alias("pct"))


_CODESET_ROWS = ", ".join(f"('{name}', '{code}')" for name, codes, _ in B.FLAG_GROUPS for code in codes)


@query("codeset_prevalence", ops=("A14",), sql=with_sql() + f""",
cs(group_name, code) AS (VALUES {_CODESET_ROWS})
SELECT cs.group_name, count(DISTINCT e.subject_id) AS subjects,
       round(count(DISTINCT e.subject_id) * 100.0 / {TOTAL_SUBJECTS_SQL}, 6) AS pct
FROM code_events e JOIN cs ON cs.code = e.code GROUP BY cs.group_name""")
def q_codeset_prevalence(spark, d):
    """Prevalence per named code set in one pass: a code -> group table
    (bounded by the code-set parameter) broadcast-joined to the events."""
    spark_ = spark
    cs = spark_.createDataFrame([(name, code) for name, codes, _ in B.FLAG_GROUPS for code in codes],
                                "group_name string, code string")
    e = B.frames(spark, d).code_events()
    return (e.join(F.broadcast(cs), "code").groupBy("group_name")
            .agg(F.count_distinct("subject_id").alias("subjects"))
            .withColumn("pct", r6(F.col("subjects") * 100.0 / _total(spark, d))))


@query("top20_codes", ops=("A15",), sql=with_sql() + f"""
SELECT code, n AS subjects, round(n * 100.0 / {TOTAL_SUBJECTS_SQL}, 6) AS pct FROM (
  SELECT code, count(DISTINCT subject_id) AS n FROM code_events GROUP BY code ORDER BY n DESC, code LIMIT 20)""")
def q_top20_codes(spark, d):
    e = B.frames(spark, d).code_events()
    top = (e.groupBy("code").agg(F.count_distinct("subject_id").alias("subjects"))
           .orderBy(F.col("subjects").desc(), F.col("code")).limit(20))
    return top.withColumn("pct", r6(F.col("subjects") * 100.0 / _total(spark, d)))


@query("top20_items", ops=("A16",), sql=with_sql() + """
SELECT item_id, count(DISTINCT subject_id) AS subjects, count(*) AS events FROM item_events
GROUP BY item_id ORDER BY subjects DESC, events DESC, item_id LIMIT 20""")
def q_top20_items(spark, d):
    e = B.frames(spark, d).item_events()
    return (e.groupBy("item_id").agg(F.count_distinct("subject_id").alias("subjects"),
                                     F.count(F.lit(1)).alias("events"))
            .orderBy(F.col("subjects").desc(), F.col("events").desc(), "item_id").limit(20))


@query("encounter_classes", ops=("A17",), sql="""
SELECT o_orderpriority AS encounterclass, count(*) AS n, round(avg(o_totalprice), 6) AS avg_cost
FROM orders GROUP BY 1""")
def q_encounter_classes(spark, d):
    return (B.frames(spark, d).encounters().groupBy("encounterclass")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("total_cost")).alias("avg_cost")))


_OBS_CODES = ("click", "view", "purchase", "signup", "error")


@query("observation_coverage", ops=("A18",), sql=f"""
SELECT event_type AS code, count(DISTINCT user_id) AS subjects,
       round(count(DISTINCT user_id) * 1.0 / {TOTAL_SUBJECTS_SQL}, 6) AS coverage
FROM events WHERE event_type IN ({", ".join(repr(c) for c in _OBS_CODES)}) GROUP BY 1""")
def q_observation_coverage(spark, d):
    o = B.frames(spark, d).observations().filter(F.col("code").isin(list(_OBS_CODES)))
    return (o.groupBy("code").agg(F.count_distinct("subject_id").alias("subjects"))
            .withColumn("coverage", r6(F.col("subjects") / _total(spark, d))))


@query("category_counts", ops=("A19", "P14"), sql="""
SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1""")
def q_category_counts(spark, d):
    f = scalar_frame(spark, d)
    labels = {v: k for k, v in B.SEGMENT_CODES.items()}
    return (f.groupBy("category_code").agg(F.count(F.lit(1)).alias("n"))
            .select(E.category_label("category_code", labels, "OTHER").alias("category"), "n"))


@query("binary_counts", ops=("A19", "P13", "P14"), sql="""
SELECT CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'not negative' END AS label, count(*) AS n FROM customer GROUP BY 1""")
def q_binary_counts(spark, d):
    """Subjects by binary code, from the demographics alone."""
    from quillon.operators.features import demographics
    codes = demographics(B.frames(spark, d).demographics_input(), SPEC)
    return (codes.groupBy("binary_code").agg(F.count(F.lit(1)).alias("n"))
            .select(E.category_label("binary_code", {1: "negative", 0: "not negative"}).alias("label"), "n"))


@query("balance_summary", ops=("A20",), sql="""
SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std,
       min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 6) AS q25,
       round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75,
       max(c_acctbal) AS max FROM customer""")
def q_balance_summary(spark, d):
    """Quantiles by distributed selection; the other figures are one aggregate."""
    c = B.frames(spark, d).subjects()
    quartiles = exact_quantiles(c, "balance", (0.25, 0.5, 0.75))
    return c.agg(F.count("balance").alias("n"), r6(F.avg("balance")).alias("mean"),
                 r6(F.stddev_samp("balance")).alias("std"), F.min("balance").alias("min"),
                 *[r6(F.lit(q).cast("double")).alias(f"q{p}") for q, p in zip(quartiles, (25, 50, 75))], F.max("balance").alias("max"))


@query("price_histogram", ops=("A21", "P23"), sql="""
SELECT CAST(floor(least(o_totalprice, 400000.0) / 50000.0) AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY 1""")
def q_price_histogram(spark, d):
    e = B.frames(spark, d).encounters()
    return (e.select(F.floor(E.clip_upper("total_cost", 400000.0) / 50000.0).cast("int").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


_SCALARS = FLAGS + ["age", "num_items", "num_encounters", "num_codes", "binary_code", "category_code"]
_PAIRS = [(a, b) for i, a in enumerate(_SCALARS) for b in _SCALARS[i + 1:]]


@query("feature_correlation", ops=("A22",), sql=with_sql(FRAG_FEAT) + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM feat" for a, b in _PAIRS))
def q_feature_correlation(spark, d):
    """Pearson matrix (upper triangle) in ONE aggregate pass."""
    f = scalar_frame(spark, d)
    row = f.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in _PAIRS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                   F.col(f"{a}__{b}").alias("r")) for a, b in _PAIRS])).alias("x")
                      ).select("x.a", "x.b", r6(F.col("x.r")).alias("r"))


@query("code_vector_stats", ops=("A23",), sql=with_sql(FRAG_VOCAB, FRAG_VECTORS, FRAG_CODE_VOCAB, FRAG_CODE_HELD) + f"""
, cells AS (SELECT 'code' AS vector, c.c_custkey AS subject_id, v.pos, CASE WHEN h.subject_id IS NULL THEN 0.0 ELSE 1.0 END AS x,
              h.subject_id IS NOT NULL AS nz
            FROM customer c CROSS JOIN cvocab v LEFT JOIN held h ON h.subject_id = c.c_custkey AND h.code = v.code
            UNION ALL
            SELECT 'item', sm.subject_id, sm.pos, sm.x / nrm.nrm, sm.x <> 1e-4 FROM sm JOIN nrm ON sm.subject_id = nrm.subject_id),
per AS (SELECT vector, subject_id, count_if(nz) AS nz FROM cells GROUP BY 1, 2)
SELECT vector, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round((SELECT avg(nz) FROM per p WHERE p.vector = c.vector), 6) AS nz_mean,
       CAST((SELECT max(nz) FROM per p WHERE p.vector = c.vector) AS INTEGER) AS nz_max FROM cells c GROUP BY vector, pos""")
def q_code_vector_stats(spark, d):
    """Per-dimension mean of the code and the item vector, and the nonzero count
    per row (before smoothing) summarised, from one stored feature frame."""
    f = stored(feature_frame(spark, d, keep_double_vector=True), "features")
    part = lambda name, col, nz: F.struct(F.lit(name).alias("vector"), F.col(col).cast("array<double>").alias("v"), nz.alias("nz"))
    rows = f.select(F.inline(F.array(part("code", "code_vector", F.size(F.filter("code_vector", lambda x: x != 0))),
                                     part("item", "item_vector_d", F.col("item_nonzero")))))
    dims = rows.select("vector", F.posexplode("v").alias("pos", "x")).groupBy("vector", "pos").agg(r6(F.avg("x")).alias("mean"))
    nz = rows.groupBy("vector").agg(r6(F.avg("nz")).alias("nz_mean"), F.max("nz").alias("nz_max"))  # two rows
    return dims.join(F.broadcast(nz), "vector").select("vector", "pos", "mean", "nz_mean", "nz_max")


@query("calendar_age", ops=("P16",), sql=f"""
SELECT o_custkey AS subject_id, year(DATE '{B.AS_OF_DATE}') - year(min(o_orderdate)) AS years
FROM orders GROUP BY 1""")
def q_calendar_age(spark, d):
    di = B.frames(spark, d).demographics_input().filter(F.col("end_date").isNull() & F.col("start_date").isNotNull())
    return di.select("subject_id", E.calendar_age("start_date", B.AS_OF_DATE).cast("bigint").alias("years"))


# ---------------------------------------------------------------- lookups
@query("flag_filter_page", ops=("P17", "P19"), sql=with_sql(FRAG_FEAT) + """
SELECT subject_id, age, num_items, (SELECT count(*) FROM feat WHERE has_group_a = 1 AND has_group_b = 1) AS total
FROM feat WHERE has_group_a = 1 AND has_group_b = 1 ORDER BY subject_id LIMIT 200 OFFSET 100""")
def q_flag_filter_page(spark, d):
    """Page 2 (limit 200, offset 100) of subjects with both flags, stable order, plus total."""
    f = scalar_frame(spark, d).filter((F.col("has_group_a") == 1) & (F.col("has_group_b") == 1))
    total = f.agg(F.count(F.lit(1))).scalar()
    return f.orderBy("subject_id").offset(100).limit(200).select("subject_id", "age", "num_items",
                                                                 total.alias("total"))


@query("subject_search", ops=("P18", "J7"), sql=with_sql(FRAG_FEAT) + """
SELECT f.subject_id, c.c_name AS name, f.age FROM feat f LEFT JOIN customer c ON c.c_custkey = f.subject_id
WHERE CAST(f.subject_id AS VARCHAR) LIKE '%77%' OR c.c_name ILIKE '%000007%'
ORDER BY f.subject_id LIMIT 50""")
def q_subject_search(spark, d):
    f = scalar_frame(spark, d)
    names = B.frames(spark, d).subjects().select("subject_id", "name")
    j = f.join(names, "subject_id", "left")
    return (j.filter(F.col("subject_id").cast("string").contains("77") | F.col("name").ilike("%000007%"))
            .orderBy("subject_id").limit(50).select("subject_id", "name", "age"))


@query("subject_lookup", ops=("P20",), sql=with_sql(FRAG_FEAT) + "\nSELECT * FROM feat WHERE subject_id = 42")
def q_subject_lookup(spark, d):
    return scalar_frame(spark, d).filter(F.col("subject_id") == F.lit(42))


@query("subject_overview", ops=("J8",), sql=with_sql() + """,
c AS (SELECT subject_id, count(DISTINCT code) AS n_codes,
             max(CASE WHEN code = 'Brand#1' THEN 1 ELSE 0 END) AS has_brand1 FROM code_events GROUP BY 1),
i AS (SELECT subject_id, count(DISTINCT item_id) AS n_items FROM item_events GROUP BY 1),
o AS (SELECT o_custkey AS subject_id, count(*) AS n_enc FROM orders GROUP BY 1)
SELECT cu.c_custkey AS subject_id, coalesce(c.n_codes, 0) AS n_codes, coalesce(i.n_items, 0) AS n_items,
       coalesce(o.n_enc, 0) AS n_enc, coalesce(c.has_brand1, 0) AS has_brand1
FROM customer cu LEFT JOIN c ON c.subject_id = cu.c_custkey LEFT JOIN i ON i.subject_id = cu.c_custkey
LEFT JOIN o ON o.subject_id = cu.c_custkey""")
def q_subject_overview(spark, d):
    """4-table preview: each child is pre-aggregated per subject before the
    joins, so no row fan-out happens."""
    f = B.frames(spark, d)
    c = f.code_events().groupBy("subject_id").agg(
        F.count_distinct("code").alias("n_codes"),
        F.max(F.when(F.col("code") == "Brand#1", 1).otherwise(0)).alias("has_brand1"))
    i = f.item_events().groupBy("subject_id").agg(F.count_distinct("item_id").alias("n_items"))
    o = f.encounters().groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_enc"))
    return (f.subjects().select("subject_id").join(c, "subject_id", "left").join(i, "subject_id", "left")
            .join(o, "subject_id", "left").fillna(0, subset=["n_codes", "n_items", "n_enc", "has_brand1"])
            .select("subject_id", "n_codes", "n_items", "n_enc", "has_brand1"))


@query("items_for_cohort", ops=("J9",), sql=with_sql() + """
SELECT i.item_id, count(DISTINCT i.subject_id) AS subjects FROM item_events i
WHERE i.subject_id IN (SELECT subject_id FROM code_events WHERE code IN ('Brand#1', 'Brand#2', 'Brand#3'))
GROUP BY 1""")
def q_items_for_cohort(spark, d):
    f = B.frames(spark, d)
    # Dates play no part, so rows are made distinct without them, after the cohort's filter.
    cohort = f.code_rows().filter(F.col("code").isin("Brand#1", "Brand#2", "Brand#3")).select("subject_id").distinct()
    pairs = f.item_rows().select("subject_id", "item_id").join(cohort, "subject_id", "left_semi").distinct()
    return pairs.groupBy("item_id").agg(F.count("subject_id").alias("subjects"))


# ---------------------------------------------------------------- data quality
@query("table_row_counts", ops=("V5", "V4"), sql="\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in
    TABLES))
def q_table_row_counts(spark, d):
    f = B.frames(spark, d)
    parts = [f.t(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
             for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("null_empty_rates", ops=("V6",), sql="""
SELECT 'customer' AS table_name, 'c_name' AS column_name,
       round(count_if(c_name IS NULL OR c_name = '') * 100.0 / count(*), 6) AS pct FROM customer
UNION ALL SELECT 'orders', 'o_orderpriority',
       round(count_if(o_orderpriority IS NULL OR o_orderpriority = '') * 100.0 / count(*), 6) FROM orders
UNION ALL SELECT 'events', 'props', round(count_if(props IS NULL OR props = '') * 100.0 / count(*), 6) FROM events""")
def q_null_empty_rates(spark, d):
    f = B.frames(spark, d)

    def rate(t, c):
        x = F.col(c)
        return f.t(t).agg(r6(F.count_if(x.isNull() | (x == "")) * 100.0 / F.count(F.lit(1))).alias("pct")) \
                     .select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "pct")
    return rate("customer", "c_name").unionByName(rate("orders", "o_orderpriority")).unionByName(rate("events", "props"))


@query("feature_checks", ops=("V7",), sql=with_sql(FRAG_FEAT) + """
SELECT count_if(age IS NULL) AS null_age, count_if(num_items IS NULL) AS null_items, min(age) AS min_age,
       max(age) AS max_age, array_to_string(list_sort(list(DISTINCT category_code)), ',') AS category_codes FROM feat""")
def q_feature_checks(spark, d):
    f = scalar_frame(spark, d)
    return f.agg(F.count_if(F.col("age").isNull()).alias("null_age"),
                 F.count_if(F.col("num_items").isNull()).alias("null_items"),
                 F.min("age").alias("min_age"), F.max("age").alias("max_age"),
                 F.array_join(F.sort_array(F.collect_set(F.col("category_code").cast("string"))), ",")
                  .alias("category_codes"))


# ---------------------------------------------------------------- recommendation store
SQL_POP_RECS = with_sql(FRAG_FEAT) + """,
hist AS (SELECT subject_id, item_id, max(start_date) AS last_date FROM item_events GROUP BY 1, 2),
popc AS (SELECT item_id, count(*) AS freq, count(*) / max(count(*)) OVER () AS pop FROM hist GROUP BY 1),
precs AS (SELECT * FROM (SELECT c.c_custkey AS subject_id, p.item_id, p.pop AS score,
            row_number() OVER (PARTITION BY c.c_custkey ORDER BY p.freq DESC, p.item_id) AS rank
          FROM customer c CROSS JOIN popc p
          WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.subject_id = c.c_custkey AND h.item_id = p.item_id))
          WHERE rank <= 7)"""


def pop_store(spark, d, k=7):
    f = B.frames(spark, d)
    hist = NB.item_history(f.item_events())
    pop = NB.item_popularity(hist, f.subjects())
    ranked = R.global_rank(pop, [F.col("freq").desc(), F.col("item_id").asc()], "grank")
    t = R.top_k_excluding(ranked, f.subjects(), hist, k, rank_col="grank")
    return (R.top_k(t, k, score="pop").select("subject_id", "item_id", F.col("pop").alias("score"), "rank")
            .withColumn("model_version", F.lit("popularity-v1")))


@query("store_by_version", ops=("A24",), sql=SQL_POP_RECS + """
SELECT 'popularity-v1' AS model_version, count(DISTINCT subject_id) AS subjects, count(*) AS n_rows,
       round(avg(score), 4) AS avg_score FROM precs""")
def q_store_by_version(spark, d):
    return (pop_store(spark, d).groupBy("model_version")
            .agg(F.count_distinct("subject_id").alias("subjects"), F.count(F.lit(1)).alias("n_rows"),
                 F.round(F.avg("score"), 4).alias("avg_score")))


@query("most_recommended", ops=("A25",), sql=SQL_POP_RECS + """
SELECT item_id, count(*) AS n, round(avg(score), 6) AS avg_score FROM precs GROUP BY 1
ORDER BY n DESC, item_id LIMIT 15""")
def q_most_recommended(spark, d):
    return (pop_store(spark, d).groupBy("item_id")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("avg_score"))
            .orderBy(F.col("n").desc(), "item_id").limit(15))


@query("rec_coverage", ops=("A28",), sql=SQL_POP_RECS + f"""
SELECT round(count(DISTINCT subject_id) * 1.0 / {TOTAL_SUBJECTS_SQL}, 6) AS coverage FROM precs""")
def q_rec_coverage(spark, d):
    return pop_store(spark, d).agg(r6(F.count_distinct("subject_id") / _total(spark, d)).alias("coverage"))


@query("rec_contract_check", ops=("V8",), sql=SQL_POP_RECS + """,
per AS (SELECT subject_id, count(*) AS n, count_if(item_id IS NULL OR score IS NULL) AS missing,
               count_if(score < 0 OR score > 1) AS out_of_range FROM precs GROUP BY 1)
SELECT CAST(count_if(n < 1 OR n > 7) AS BIGINT) AS bad_count, CAST(sum(missing) AS BIGINT) AS missing_fields,
       CAST(sum(out_of_range) AS BIGINT) AS bad_scores FROM per""")
def q_rec_contract_check(spark, d):
    return ST.contract_violations(pop_store(spark, d), 7)


@query("rec_explanations", ops=("P21", "P22", "J11"), sql=SQL_POP_RECS + f"""
SELECT r.subject_id, CAST(r.rank AS INTEGER) AS rank, r.item_id,
       CASE WHEN r.score > 0.8 THEN 'high' WHEN r.score > 0.6 THEN 'medium' ELSE 'low' END AS badge,
       printf('place %d, score %.1f of 100: %s (%d encounters, %d codes on record)', r.rank, round(r.score * 100.0, 1),
         CASE WHEN {" AND ".join(f"f.{c} <> 1" for c, _ in PHRASES)} THEN 'chosen by similar histories'
              ELSE concat_ws('; ', {", ".join(f"CASE WHEN f.{c} = 1 THEN '{p}' END" for c, p in PHRASES)}) END,
         f.num_encounters, f.num_codes) AS explanation
FROM precs r JOIN feat f ON f.subject_id = r.subject_id""")
def q_rec_explanations(spark, d):
    r = pop_store(spark, d).join(scalar_frame(spark, d), "subject_id")
    return r.select("subject_id", F.col("rank").cast("int").alias("rank"), "item_id",
                    E.score_badge("score").alias("badge"),
                    explanation("rank", "score", PHRASES, "num_encounters", "num_codes").alias("explanation"))


@query("store_replace", ops=("S7", "S8"), sql=SQL_POP_RECS + """
SELECT subject_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score,
       CASE WHEN subject_id % 2 = 0 THEN 'v2' ELSE 'popularity-v1' END AS model_version FROM precs""")
def q_store_replace(spark, d):
    """Idempotent per-subject replace: even subjects get a new version of
    their list; applying the same update twice gives the same store."""
    old = pop_store(spark, d)
    new = old.filter(F.col("subject_id") % 2 == 0).withColumn("model_version", F.lit("v2"))
    once = ST.replace_subjects(old, new)
    twice = ST.replace_subjects(once, new)
    return twice.select("subject_id", F.col("rank").cast("int").alias("rank"), "item_id",
                        r6(F.col("score")).alias("score"), "model_version")


@query("subject_profiles", ops=("A26", "J7", "S8"), sql=SQL_POP_RECS + """,
owned AS (SELECT subject_id, item_id, max(start_date) AS last_date FROM item_events GROUP BY 1, 2),
listed AS (SELECT subject_id, item_id, last_date, CAST(NULL AS DOUBLE) AS score,
             row_number() OVER (PARTITION BY subject_id ORDER BY last_date DESC, item_id DESC) AS place FROM owned)
SELECT subject_id, 'item' AS part, CAST(place AS INTEGER) AS place, item_id, p_name AS item_name, last_date, score
FROM listed LEFT JOIN part ON p_partkey = item_id
UNION ALL
SELECT subject_id, 'recommendation', CAST(rank AS INTEGER), item_id, p_name, NULL, round(score, 6)
FROM precs LEFT JOIN part ON p_partkey = item_id WHERE rank <= 10""")
def q_subject_profiles(spark, d):
    """Every subject's profile page: its items, newest first, and the first ten
    of its stored recommendations, both named."""
    f = B.frames(spark, d)
    items, recs = PR.profile(NB.item_history(f.item_events()), pop_store(spark, d), f.item_names())
    return items.unionByName(recs).withColumn("score", r6(F.col("score")))
