"""Feature-store queries on the driver tables (slice 1 and the feature row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import features as FT
from quillon.operators import vocab as voc
from quillon.plans import binding as B
from quillon.plans.registry import query
from quillon.session import stored

SPEC = FT.FeatureSpec(
    as_of=B.AS_OF_DATE, binary_positive="Y", category_map=B.SEGMENT_CODES,
    category_other=B.SEGMENT_OTHER, flag_groups=B.FLAG_GROUPS)


def event_pairs(spark, d):
    """(subject, item or code) pairs of one scan, stored for their readers."""
    return stored(FT.event_pairs(B.frames(spark, d).events()), "pairs")


def scalar_frame(spark, d):
    f = B.frames(spark, d)
    return FT.scalar_feature_rows(f.demographics_input(), FT.event_pairs(f.events()), f.encounters(), SPEC)


def feature_frame(spark, d, keep_double_vector=False, pairs=None):
    f = B.frames(spark, d)
    pairs = event_pairs(spark, d) if pairs is None else pairs
    return FT.feature_rows(f.demographics_input(), f.subjects(), pairs, f.encounters(), SPEC, keep_double_vector)


# --- SQL building blocks (DuckDB) -------------------------------------------
FRAG_VOCAB = """
df AS (SELECT item_id, count(DISTINCT subject_id) AS subject_count FROM item_events GROUP BY item_id),
vocab AS (SELECT * FROM (SELECT item_id, subject_count,
            CAST(row_number() OVER (ORDER BY subject_count DESC, item_id) - 1 AS INTEGER) AS pos FROM df)
          WHERE pos < 50),
vidf AS (SELECT item_id, subject_count, pos,
           ln(((SELECT count(*) FROM customer) + 1.0) / (subject_count + 1.0)) AS idf FROM vocab),
counts AS (SELECT subject_id, item_id, count(*) AS raw_count FROM item_events GROUP BY 1, 2),
w AS (SELECT c.subject_id, c.item_id, v.pos, c.raw_count, v.idf, ln(1 + c.raw_count) * v.idf AS tfidf
      FROM counts c JOIN vidf v ON c.item_id = v.item_id)"""

FRAG_CODE_HELD = """
held AS (SELECT DISTINCT subject_id, code FROM code_events)"""


def with_sql(*frags: str) -> str:
    """Compose CTE fragments into one WITH clause (base event CTEs first)."""
    return "WITH " + ",".join([B.SQL_ITEM_EVENTS, B.SQL_CODE_EVENTS] + list(frags))


SQL_VOCAB = with_sql(FRAG_VOCAB)

FRAG_VECTORS = """
grid AS (SELECT c.c_custkey AS subject_id, v.pos FROM customer c CROSS JOIN vidf v),
sm AS (SELECT g.subject_id, g.pos, coalesce(w.tfidf, 0) + 1e-4 AS x
       FROM grid g LEFT JOIN w ON g.subject_id = w.subject_id AND g.pos = w.pos),
nrm AS (SELECT subject_id, sqrt(sum(x * x)) AS nrm FROM sm GROUP BY subject_id)"""

FRAG_CODE_VOCAB = """
cdf AS (SELECT code, count(DISTINCT subject_id) AS subject_count FROM code_events GROUP BY code),
cvocab AS (SELECT * FROM (SELECT code, subject_count,
             CAST(row_number() OVER (ORDER BY subject_count DESC, code) - 1 AS INTEGER) AS pos FROM cdf)
           WHERE pos < 50)"""
SQL_VECTORS = with_sql(FRAG_VOCAB, FRAG_VECTORS)
SQL_CODE_VOCAB = with_sql(FRAG_CODE_VOCAB, FRAG_CODE_HELD)


@query("vocab_tfidf", ops=("A4", "A5", "W1", "T3", "T4", "J3", "S2"), sql=SQL_VOCAB + """
SELECT subject_id, item_id, pos, raw_count, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM w""")
def q_vocab_tfidf(spark, d):
    f = B.frames(spark, d)
    _, w = voc.vocabulary_tfidf(f.item_events(), f.subjects(), 50)
    return w.select("subject_id", "item_id", F.col("pos").cast("int").alias("pos"), "raw_count",
                    F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"))


@query("item_vocabulary", ops=("A5", "W1"), sql=SQL_VOCAB + """
SELECT item_id, subject_count, pos FROM vocab""")
def q_item_vocabulary(spark, d):
    f = B.frames(spark, d)
    v = voc.top_n_vocabulary(voc.document_frequency(f.item_events()), 50)
    return v.select("item_id", "subject_count", F.col("pos").cast("int").alias("pos"))


@query("item_vector_long", ops=("T5", "T2", "A7", "J1"), sql=SQL_VECTORS + """
SELECT sm.subject_id, sm.pos, round(sm.x / nrm.nrm, 6) AS weight FROM sm JOIN nrm ON sm.subject_id = nrm.subject_id""")
def q_item_vector_long(spark, d):
    it = feature_frame(spark, d, keep_double_vector=True)
    return it.select("subject_id", F.posexplode("item_vector_d").alias("pos", "w")).select(
        "subject_id", F.col("pos").cast("int").alias("pos"), F.round("w", 6).alias("weight"))


@query("code_vector_long", ops=("T1", "T2", "A3", "W1"), sql=SQL_CODE_VOCAB + """
SELECT c.c_custkey AS subject_id, v.pos,
       CAST(CASE WHEN h.subject_id IS NULL THEN 0.0 ELSE 1.0 END AS FLOAT) AS value
FROM customer c CROSS JOIN cvocab v
LEFT JOIN held h ON h.subject_id = c.c_custkey AND h.code = v.code""")
def q_code_vector_long(spark, d):
    c = feature_frame(spark, d)
    return c.select("subject_id", F.posexplode("code_vector").alias("pos", "value")).select(
        "subject_id", F.col("pos").cast("int").alias("pos"), "value")


_FLAG_SQL = ",\n".join(
    f"  CAST(coalesce(max(CASE WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN 1 ELSE 0 END), 0) AS TINYINT) AS {name}"
    for name, codes, _ in B.FLAG_GROUPS)
_SEG_SQL = " ".join(f"WHEN lower(c_mktsegment) = '{k.lower()}' THEN {v}" for k, v in B.SEGMENT_CODES.items())
FRAG_FEAT = f"""
first AS (SELECT o_custkey AS subject_id, min(CAST(o_orderdate AS DATE)) AS start_date FROM orders GROUP BY 1),
demo AS (SELECT c.c_custkey AS subject_id,
           CAST(trunc(date_diff('day', f.start_date, DATE '{B.AS_OF_DATE}') / 365.25) AS INTEGER) AS age,
           CAST(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS TINYINT) AS binary_code,
           CAST(CASE {_SEG_SQL} ELSE {B.SEGMENT_OTHER} END AS TINYINT) AS category_code
         FROM customer c LEFT JOIN first f ON f.subject_id = c.c_custkey),
cond AS (SELECT subject_id, CAST(count(DISTINCT code) AS INTEGER) AS num_codes,
{_FLAG_SQL}
         FROM code_events GROUP BY subject_id),
items AS (SELECT subject_id, CAST(count(DISTINCT item_id) AS INTEGER) AS num_items FROM item_events GROUP BY 1),
enc AS (SELECT o_custkey AS subject_id, CAST(count(o_orderkey) AS INTEGER) AS num_encounters FROM orders GROUP BY 1),
feat AS (
SELECT d.subject_id, d.age, d.binary_code, d.category_code,
       coalesce(c.num_codes, 0) AS num_codes, coalesce(i.num_items, 0) AS num_items,
       coalesce(e.num_encounters, 0) AS num_encounters,
       {", ".join(f"coalesce(c.{g[0]}, CAST(0 AS TINYINT)) AS {g[0]}" for g in B.FLAG_GROUPS)}
FROM demo d LEFT JOIN cond c ON c.subject_id = d.subject_id
LEFT JOIN items i ON i.subject_id = d.subject_id
LEFT JOIN enc e ON e.subject_id = d.subject_id)"""
SQL_FEATURE_SCALARS = with_sql(FRAG_FEAT)


@query("feature_scalars", ops=("P13", "P15", "A1", "A2", "A6", "J1", "J2", "P24"),
       sql=SQL_FEATURE_SCALARS + "\nSELECT * FROM feat")
def q_feature_scalars(spark, d):
    return scalar_frame(spark, d)


@query("feature_rows", ops=("J2", "S2", "P24", "T1", "T5"), sql=with_sql(FRAG_VOCAB, FRAG_VECTORS, FRAG_CODE_VOCAB, FRAG_CODE_HELD, FRAG_FEAT) + f""",
long AS (SELECT c.c_custkey AS subject_id, 'code' AS part, v.pos, CASE WHEN h.subject_id IS NULL THEN 0.0 ELSE 1.0 END AS value
         FROM customer c CROSS JOIN cvocab v LEFT JOIN held h ON h.subject_id = c.c_custkey AND h.code = v.code
         UNION ALL
         SELECT sm.subject_id, 'item', sm.pos, sm.x / nrm.nrm FROM sm JOIN nrm ON sm.subject_id = nrm.subject_id)
SELECT feat.*, '{FT.FEATURE_VERSION}' AS feature_version, true AS stamped, part, CAST(pos AS INTEGER) AS pos, round(CAST(value AS FLOAT), 5) AS value
FROM feat JOIN long USING (subject_id)""")
def q_feature_rows(spark, d):
    """The whole feature row with its version and created stamp, one row per
    subject and vector position (code vector, then item vector)."""
    f = feature_frame(spark, d)
    part = lambda name: F.transform(f"{name}_vector", lambda v, k: F.struct(F.lit(name).alias("part"), k.alias("pos"), v.alias("value")))
    return (f.withColumn("stamped", F.col("created_at").isNotNull())
            .select(*[c for c in f.columns if c not in ("created_at", "code_vector", "item_vector")], "stamped",
                    F.inline(F.concat(part("code"), part("item"))))
            .withColumn("value", F.round("value", 5)))
