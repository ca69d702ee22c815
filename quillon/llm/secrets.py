"""Secret scan by linking the parts of multipart credentials, with DataFrame
functions only.

Base kinds are reported wherever they stand: ``assign`` (a named secret set
to 8+ characters), ``access`` (key identifiers) and ``hex`` (long lower-case
hex).  Weak parts are found too: identifiers (``ident``), secrets (``weak``)
and endpoints (``endpoint``).  An interval join within scopes (text between
blank lines) looks for complementary parts at most ``reach`` characters
away; a weak part is reported only where such a part co-occurs:

    ident     with a secret (assign, hex, weak)
    weak      with an identifier (access, ident) or an endpoint
    endpoint  with a weak or assigned secret that itself has an identifier

Parts of a kind are pre-aggregated to one row for each bin of ``reach``
characters (first and last position), so the join's rows are linear in the
parts even where thousands stand in one scope.

Positions come from splitting the text at the matches and summing the lengths
of pieces and matches, in code points.

Defined cases: null and empty text have no spans; rows equal in doc_id and
text get a result each; null ids are kept; a document's spans are ordered by
start, then by kind as in ``KINDS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import row_key, text_or_empty, written

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(["password", "passwd", "secret", "token", "api_?key"])
_ASSIGN = "|".join(_either_case(w) for w in _NAMES.split("|")).join("()") \
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_IDENT = r"(?:(?i:client_id|access_key_id|account|username|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}|\b(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,})"
_WEAK = r"(?:(?i:private_key|client_secret|credential|pass|pwd|auth)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,}|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=]))"
_ENDPOINT = r"(?:https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_SCOPE = r"\n[\x20\t\r]*\n"
# kind, pattern, least length of a match, group with a least length of 8.
PATTERNS = (
    ("assign", _ASSIGN, 1, 2),
    ("access", "AKIA[A-Z0-9]+", 16, 0),
    ("hex", "[0-9a-f]{32,}", 32, 0),
    ("ident", _IDENT, 1, 0),
    ("weak", _WEAK, 1, 0),
    ("endpoint", _ENDPOINT, 1, 0),
    ("scope", _SCOPE, 1, 0),
)


def _found(kind: str, pattern: str, least: int, group: int):
    """Matches as structs (kind, n, gap, len, ok): gap is the length of the
    text since the previous match; ``ok`` tells whether the match counts."""
    p = F.lit(pattern)
    gaps = F.split("text", pattern, -1)
    hits = F.regexp_extract_all("text", p, F.lit(0))
    held = F.regexp_extract_all("text", p, F.lit(group)) if group else hits
    rows = F.transform(F.arrays_zip(hits.alias("hit"), held.alias("held"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap")),
                       lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(x["gap"]).alias("gap"),
                                             F.length(x["hit"]).alias("len"),
                                             ((F.length(x["hit"]) >= least) & ((F.length(x["held"]) >= 8) if group else F.lit(True))).alias("ok")))
    return F.when(F.col("text").rlike(pattern), rows)


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, copies, kind, start, end) of every part; a document
    without any has one row with a null kind."""
    base = docs.select("doc_id", row_key("doc_id", "text").alias("row"), text_or_empty().alias("text"))
    none = F.array().cast("array<struct<kind:string,n:int,gap:int,len:int,ok:boolean>>")
    cols = {k: F.coalesce(_found(k, *rest), none) for k, *rest in PATTERNS}
    found = base.select("doc_id", "row", *[c.alias(k) for k, c in cols.items()])
    # Scopes matter only where there are weak parts.
    weak = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in ("ident", "weak", "endpoint")])
    found = found.withColumn("scope", F.when(weak, F.col("scope")).otherwise(none))
    flat = (found.select("doc_id", "row", F.posexplode_outer(F.concat(*KINDS, "scope")).alias("at", "p"))
            .withColumn("head", F.coalesce("at", F.lit(0)) == 0))
    # Equal rows collapse here; ``copies`` counts them on their first part.
    one = (flat.groupBy("doc_id", "row", "head", "p.kind", "p.n", "p.gap", "p.len", "p.ok")
           .agg(F.count(F.lit(1)).alias("copies")))
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("doc_id", "row", "kind").orderBy("n"))
    return (one.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
            .select("doc_id", "row", F.when(F.col("head"), F.col("copies")).alias("copies"),
                    F.when(F.col("ok"), F.col("kind")).alias("kind"), "start", "end"))


def _near(parts: DataFrame, kinds: tuple, others: tuple, reach: int) -> DataFrame:
    """Parts of ``kinds`` with one of ``others`` in their scope within reach:
    an interval join on bins of ``reach`` characters."""
    key = ["doc_id", "row", "scope"]
    side = (parts.filter(F.col("kind").isin(*others))
            .groupBy(*key, F.floor(F.col("start") / reach).alias("bin"))
            .agg(F.min("start").alias("lo"), F.max("start").alias("hi")))
    left = (parts.filter(F.col("kind").isin(*kinds))
            .withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)))))
    same = reduce(lambda x, y: x & y, [left[c].eqNullSafe(side[c]) for c in key + ["bin"]])
    inside = (side["hi"] >= left["start"] - reach) & (side["lo"] <= left["end"] + reach)
    return left.join(side, same & inside, "left_semi").drop("bin").distinct()


def credential_parts(docs: DataFrame, reach: int = 400) -> DataFrame:
    """(doc_id, row, copies, kind, start, end): base parts, and weak parts that
    are linked with a complementary one."""
    parts = _parts(docs)
    place = Window.partitionBy("doc_id", "row").orderBy("start")
    # Written once: the texts are scanned a single time for all joins below.
    scoped = written(parts.withColumn("scope", F.count(F.when(F.col("kind") == "scope", 1)).over(place)), "parts")
    base = scoped.filter("kind is null or kind in ('assign', 'access', 'hex')")
    loose = scoped.filter("kind <> 'scope'")
    ident = _near(loose, ("ident",), ("assign", "hex", "weak"), reach)
    weak = _near(loose, ("weak",), ("access", "ident", "endpoint"), reach)
    named = _near(loose, ("weak", "assign"), ("access", "ident"), reach)
    ends = _near(named.union(loose.filter("kind = 'endpoint'")), ("endpoint",), ("weak", "assign"), reach)
    # Only spans are wanted of the linked parts; the copies stand on the base rows.
    heads = scoped.filter("copies is not null and kind in ('ident', 'weak', 'endpoint', 'scope')").withColumn("kind", F.lit(None).cast("string"))
    linked = ident.unionByName(weak).unionByName(ends).withColumn("copies", F.lit(None).cast("long"))
    return base.unionByName(heads).unionByName(linked).drop("scope")


def _joined(kinds: tuple):
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = F.sort_array(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("start", order.alias("k"), "end", "kind"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, reach: int = 400) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their
    spans and all spans."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    return (credential_parts(docs, reach).groupBy("doc_id", "row")
            .agg(F.sum("copies").alias("copies"), *[count(k) for k in KINDS],
                 F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_ident", "n_weak", "n_endpoint"))
