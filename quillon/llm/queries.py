"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import (licenses, linededup, merkle, mixing, ngramjoin, packing, permutation, quality, records, secrets,
                         substrings, whitening, wholetokens)
from quillon.llm.common import documents
from quillon.llm.tokens import vocabulary_path
from quillon.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    return quality.train(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@query("op3_line_crf_quality")
def op3(spark, sf_dir):
    return quality.rated(documents(spark, sf_dir), quality_model(spark, sf_dir))


@query("op4_token_records")
def op4(spark, sf_dir):
    index = records.write_and_index(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
capped AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::DOUBLE AS weight, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM per),
filled AS (SELECT *, cap / weight AS fill,
  (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM capped),
src AS (SELECT *, least(weight * coalesce(max(v) FILTER (v <= fill) OVER (), max(fill) OVER ()), cap::DOUBLE) AS target FROM filled),
rows AS (SELECT d.doc_id, d.size, s.rank, s.weight, s.source_size, s.target, s.budget,
  sum(d.size) OVER (PARTITION BY s.rank ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.size), d.doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
total AS (SELECT *, sum(size) OVER (ORDER BY (turn * source_size + cum) / weight, rank, turn, cum ROWS UNBOUNDED PRECEDING) AS total
  FROM rows, (VALUES (0), (1)) t(turn) WHERE size > 0)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(sum(t.size) FILTER (t.total <= t.budget), 0)::BIGINT AS taken
FROM rows r LEFT JOIN total t ON r.size > 0 AND t.rank = r.rank AND t.cum = r.cum
GROUP BY r.doc_id, r.size, r.source_size, r.target, r.rank, r.cum"""


@query("op5_fair_mix", OP5_SQL)
def op5(spark, sf_dir):
    mix = mixing.fair_mix(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_bin_slack_packing")
def op10(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


@query("op7_fuzzy_line_dedup")
def op7(spark, sf_dir):
    return linededup.line_report(documents(spark, sf_dir))


@query("op6_grouped_prefix_join")
def op6(spark, sf_dir):
    return ngramjoin.similar_components(documents(spark, sf_dir))


@query("op1_linked_secrets")
def op1(spark, sf_dir):
    return secrets.secret_report(documents(spark, sf_dir))


@query("op9_license_diagonals")
def op9(spark, sf_dir):
    return licenses.license_report(documents(spark, sf_dir))


@query("op8_permutation_index")
def op8(spark, sf_dir):
    return permutation.nearest(read_table(spark, sf_dir, "embeddings"))


@query("op2_induced_substring_dedup")
def op2(spark, sf_dir):
    return substrings.repeated_substrings(documents(spark, sf_dir))


@query("op11_whole_token_counts")
def op11(spark, sf_dir):
    return wholetokens.token_counts(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


@query("op12_multiplicity_whitening")
def op12(spark, sf_dir):
    return whitening.whitened_rows(read_table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1)))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t
  FROM (SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS tampered FROM f)),
lv AS (
  SELECT t, 0 AS level, idx, leaf AS h FROM p
  UNION ALL
  SELECT t, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM lv) WHERE n > 1 GROUP BY t, level, idx // 2),
sub AS (SELECT t, level AS top, h FROM lv QUALIFY level = max(level) OVER (PARTITION BY t)),
rv AS (
  SELECT 0 AS level, t AS idx, h FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM rv) WHERE n > 1 GROUP BY level, idx // 2),
root AS (SELECT level AS top, h FROM rv QUALIFY level = max(level) OVER ()),
c AS (
  SELECT p.doc_id, p.leaf, p.t, sub.top, sub.h AS subroot, 0 AS level, p.idx, coalesce(p.tampered, p.leaf) AS folded, '' AS path
  FROM p JOIN sub USING (t)
  UNION ALL
  SELECT c.doc_id, c.leaf, c.t, c.top, c.subroot, c.level + 1, c.idx // 2,
    sha256(CASE WHEN c.idx % 2 = 1 THEN coalesce(s.h, '') || c.folded ELSE c.folded || coalesce(s.h, '') END), c.path || coalesce(s.h, '')
  FROM c LEFT JOIN lv s ON s.t = c.t AND s.level = c.level AND s.idx = xor(c.idx, 1) WHERE c.level < c.top),
e AS (
  SELECT c.doc_id, c.leaf, c.subroot, root.top, root.h AS root, 0 AS level, c.t AS idx, c.folded, c.path
  FROM c, root WHERE c.level = c.top
  UNION ALL
  SELECT e.doc_id, e.leaf, e.subroot, e.top, e.root, e.level + 1, e.idx // 2,
    sha256(CASE WHEN e.idx % 2 = 1 THEN coalesce(s.h, '') || e.folded ELSE e.folded || coalesce(s.h, '') END), e.path || coalesce(s.h, '')
  FROM e LEFT JOIN rv s ON s.level = e.level AND s.idx = xor(e.idx, 1) WHERE e.level < e.top)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM e WHERE level = top"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    return merkle.verified_manifest(documents(spark, sf_dir)).drop("tampered")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
