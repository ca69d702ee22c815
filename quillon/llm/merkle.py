"""Merkle manifest of a dataset, verified by a recursive query per leaf.

Every row is a leaf, every language a tree over its leaves in id order, and
the subroots form a last tree.  ``build`` gives each leaf its global position
by a range sort (no window over a whole language), cuts the positions of a
tree into blocks of ``2^STRIDE`` leaves and builds ``STRIDE`` levels of a block
at a time with array functions; the blocks' tops are the leaves of the next
pass.  The node rows that are stored link a node to its ancestor ``STRIDE``
levels up and carry the siblings between (``stride=1`` stores plain parent
links).  ``climb`` is a recursive common table expression: each leaf ascends
over these links, appends the siblings and folds its tampered hash.

The node row of a leaf carries the leaf itself, so the climb starts from it
without a join; the rows above are fewer by ``2^STRIDE`` and are broadcast up
to a counted limit.  Beyond it the climb joins by shuffle: a node is named by
the position of its first leaf, its level, and a range of ``2^SPAN`` leaf
positions below it, so that no join key has more rows than that, whatever share
of the rows one language or the root holds.

Defined cases: leaves ascend by (doc_id, null first, then leaf hash), so equal
rows, whose leaves are equal, may stand in either order; a null language is a
tree of its own; null columns hash as ``-`` and an empty text as ``0:``; a row
with a null id or null ``n_chars`` is never tampered with; the largest long
plus one counts as null; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import maybe_broadcast, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one stored link spans, and the bits of a join range.
STRIDE, SPAN = 10, 14
#: Node rows above the leaves' own that are broadcast to the climb.
BROADCAST_ROWS = 100_000
# Levels of the last tree are counted from ROOT on; END names the root itself.
ROOT, END = 64, 128


def field(c):
    """``-`` for null, else UTF-8 byte count, colon and value."""
    s = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts):
    return F.sha2(F.concat(*parts), 256)


def as_text(c):
    """A stored digest (32 bytes) in the form that is hashed."""
    return F.lower(F.hex(c))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and tampered: the leaf with one added to ``n_chars``
    where 7 divides the id's checksum, else null."""
    more = {"n_chars": F.try_add(F.col("n_chars").cast("long"), F.lit(1).cast("long"))}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.unhex(digest(*[field(c) for c in FIELDS])).alias("leaf"),
                       F.when(hit, F.unhex(digest(*[field(more.get(c, c)) for c in FIELDS]))).alias("tampered"))


def positions(rows: DataFrame, order: list, name: str, out: str = "at") -> DataFrame:
    """Written rows with their place, from 0, in a total order: a range sort
    whose partition sizes (one row a partition) become offsets.

    A row number breaks ties, so a repeated row is no hot range."""
    # The tie column is a hash of the row's place in the written input.
    rows = written(rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())), name)
    laid = written(rows.orderBy(*order, "__tie").withColumn("__part", F.spark_partition_id())
                   .withColumn("__row", F.monotonically_increasing_id()).drop("__tie"), name)
    sizes = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return (laid.join(F.broadcast(offsets), "__part")
            .withColumn(out, F.col("__before") + F.col("__row") - F.col("__first"))
            .drop("__part", "__row", "__first", "__before"))


def _height(n):
    """Levels above the leaves of a tree of n leaves: bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _next_level(low):
    """Hashes of every two consecutive nodes of an array, the last run alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(low) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(low, 2 * i), F.coalesce(F.get(low, 2 * i + 1), F.lit(""))))


def _pass(nodes: DataFrame, level: int, stride: int, base: int, top: int) -> DataFrame:
    """Blocks of one pass: members (node rows) and the block's top node.

    ``nodes``: tree, idx, lo, hi (leaf positions below), hash, height, and for
    leaves of documents doc_id and tampered, which the members carry on."""
    steps = F.least(F.lit(stride), F.col("height") - level)
    own = [c for c in ("doc_id", "tampered") if c in nodes.columns]
    node = F.struct("idx", "hash", "lo", "hi", *own)
    blocks = (nodes.withColumn("block", F.shiftright("idx", stride)).groupBy("tree", "block")
              .agg(F.first("height").alias("height"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                   F.array_sort(F.collect_list(node)).alias("m"))  # at most 2^stride nodes
              .withColumn("steps", steps).withColumn("l0", F.transform("m", lambda x: as_text(x["hash"]))))
    for s in range(stride):
        blocks = blocks.withColumn(f"l{s + 1}", F.when(F.col("steps") > s, _next_level(F.col(f"l{s}"))).otherwise(F.col(f"l{s}")))

    def member(x, i):
        beside = F.array(*[F.unhex(F.get(F.col(f"l{s}"), F.shiftright(i, s).bitwiseXOR(F.lit(1)))) for s in range(stride)])
        return F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), i.alias("place"), F.slice(beside, 1, F.col("steps")).alias("siblings"),
                        *[x[c].alias(c) for c in ("hash", *own) if own])

    up_level = F.when(F.col("height") - level <= stride, F.lit(top)).otherwise(F.lit(base + level + stride))
    return blocks.select("tree", F.col("block").alias("idx"), "lo", "hi", "height", F.unhex(F.get(F.col(f"l{stride}"), F.lit(0))).alias("hash"),
                         F.lit(base + level).alias("level"), up_level.alias("up_level"), F.transform("m", member).alias("members"))


def _tree(nodes: DataFrame, height: int, stride: int, base: int, top: int) -> tuple[list[DataFrame], DataFrame]:
    """All passes over the leaves of some trees: stored blocks, and the trees'
    tops (tree, hash) of those with more than one leaf."""
    blocks, tops = [], []
    for level in range(0, height, stride):
        made = written(_pass(nodes.filter(F.col("height") > level), level, stride, base, top), "merkle")
        blocks.append(made)
        tops.append(made.filter(F.col("height") <= level + stride).select("tree", "hash"))
        nodes = made.filter(F.col("height") > level + stride).select("tree", "idx", "lo", "hi", "hash", "height")
    return blocks, tops


def build(docs: DataFrame, stride: int = STRIDE, span: int = SPAN) -> dict:
    """Leaf rows, upper node rows, trees with their subroots, the root."""
    placed = positions(leaves(docs), [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"], "leaves")
    sizes = placed.groupBy("lang").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("size"))
    langs = written(positions(sizes, ["tree"], "langs", "place").withColumn("height", _height(F.col("size"))), "langs")
    n_langs, height = langs.agg(F.count(F.lit(1)), F.coalesce(F.max("height"), F.lit(0))).first()
    known = maybe_broadcast(langs.select(F.col("lang").alias("__lang"), "tree", "size", "height"))
    placed = placed.join(known, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")

    nodes = placed.select("tree", (F.col("at") - F.col("tree")).alias("idx"), F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"),
                          F.col("leaf").alias("hash"), "height", "doc_id", "tampered")
    blocks, tops = _tree(nodes, height, stride, 0, ROOT)
    alone = placed.filter("size = 1")
    roots = alone.select("tree", F.col("leaf").alias("hash"))
    for t in tops:
        roots = roots.unionByName(t)
    subroots = written(langs.join(roots.withColumnRenamed("hash", "subroot"), "tree"), "subroots")
    last = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("place").alias("idx"), F.col("tree").alias("lo"),
                           (F.col("tree") + F.col("size")).alias("hi"), F.col("subroot").alias("hash"),
                           _height(F.lit(n_langs)).alias("height"))
    above, crown = _tree(last, max(0, n_langs - 1).bit_length(), stride, ROOT, END)
    root = (crown[-1] if crown else last).select(as_text("hash")).first()
    return {"leaves": leaf_rows(blocks[:1], alone, span), "subroots": subroots, "links": links(blocks[1:] + above, span, docs.sparkSession),
            "root": root[0] if root else None, "end": END if n_langs > 1 else ROOT}


def leaf_rows(first: list[DataFrame], alone: DataFrame, span: int) -> DataFrame:
    """Every leaf's own node row; a lone leaf is its subroot, with no siblings."""
    rows = alone.select("doc_id", F.col("leaf").alias("hash"), "tampered", "tree", F.shiftright("at", span).alias("span"),
                        F.col("at").alias("up_lo"), F.lit(ROOT).alias("up_level"), F.lit(0).alias("place"),
                        F.array().cast("array<binary>").alias("siblings"))
    for b in first:
        rows = rows.unionByName(
            b.select("tree", F.col("lo").alias("up_lo"), "up_level", F.inline("members"))
            .select("doc_id", "hash", "tampered", "tree", F.shiftright("lo", span).alias("span"), "up_lo", "up_level", "place", "siblings"))
    return rows


def links(blocks: list[DataFrame], span: int, spark: SparkSession) -> DataFrame:
    """Node rows above the leaves' own: lo, level, span -> up_lo, up_level, place, siblings."""
    rows = spark.createDataFrame([], "lo long, level int, span long, up_lo long, up_level int, place int, siblings array<binary>")
    for b in blocks:
        part = (b.select("level", F.col("lo").alias("up_lo"), "up_level", F.inline("members"))
                .select("lo", "level", F.explode(F.sequence(F.shiftright("lo", span), F.shiftright(F.col("hi") - 1, span))).alias("span"),
                        "up_lo", "up_level", "place", "siblings"))
        rows = rows.unionByName(part)
    return written(rows, "links")


# One step: the siblings of a node row are folded into the hash and appended.
_FOLD = """aggregate(sequence(1, size(k.siblings)), {hash}, (h, s) ->
  unhex(sha2(CASE WHEN k.siblings[s - 1] IS NULL THEN lower(hex(h))
                  WHEN (k.place >> (s - 1)) & 1 = 1 THEN lower(hex(k.siblings[s - 1])) || lower(hex(h))
                  ELSE lower(hex(h)) || lower(hex(k.siblings[s - 1])) END, 256)))"""
_APPEND = "aggregate(k.siblings, {path}, (p, s) -> p || coalesce(s, CAST('' AS BINARY)))"
_START = "coalesce(k.tampered, k.hash)"

CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, tree, tampered, span, lo, level, folded, path) AS (
  SELECT doc_id, hash, tree, tampered IS NOT NULL, span, up_lo, up_level,
         CASE WHEN size(siblings) = 0 THEN {_START} ELSE {_FOLD.format(hash=_START)} END,
         {_APPEND.format(path="CAST('' AS BINARY)")}
  FROM {{leaves}} k
  UNION ALL
  SELECT /*+ {{hint}} */ c.doc_id, c.leaf, c.tree, c.tampered, c.span, k.up_lo, k.up_level,
         {_FOLD.format(hash="c.folded")}, {_APPEND.format(path="c.path")}
  FROM climb c JOIN {{links}} k ON k.lo = c.lo AND k.level = c.level AND k.span = c.span
)
SELECT doc_id, leaf, tree, tampered, folded, sha2(lower(hex(path)), 256) AS proof_sha256 FROM climb WHERE level = {{end}}
"""


@contextmanager
def _recursion_rows(spark: SparkSession):
    """Without the session's bound on rows of a recursive query, which is a
    guard against endless ones: this one ends at the root."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def climb(manifest: dict, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every leaf at the root: doc_id, leaf, tree, tampered, folded hash and
    the hash of the siblings in order (proof_sha256)."""
    spark = manifest["leaves"].sparkSession
    hint = "BROADCAST(k)" if manifest["links"].count() <= broadcast_rows else "MERGE(k)"
    with _recursion_rows(spark):
        return written(spark.sql(CLIMB.replace("{hint}", hint), end=manifest["end"], leaves=manifest["leaves"], links=manifest["links"]), "climb")


def verified_manifest(docs: DataFrame, stride: int = STRIDE, span: int = SPAN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified and tampered (whether the row was)."""
    manifest = build(docs, stride, span)
    root = F.lit(manifest["root"]).cast("string")
    subroots = maybe_broadcast(manifest["subroots"].select("tree", as_text("subroot").alias("subroot")))
    return (climb(manifest, broadcast_rows).join(subroots, "tree")
            .select("doc_id", as_text("leaf").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", as_text("folded").alias("folded_root"),
                    (as_text("folded") == root).alias("verified"), "tampered"))
