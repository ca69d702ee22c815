"""Similarity self-join on word-shingle sets by a grouped prefix join.

1.  Texts with equal sets are one item (a representative stands for them).
2.  All shingles are put in one global order: those in a fixed hash class
    (one in five) first, rarest first by their exact document count, then the
    others by hash.  Two sets with Jaccard of at least t share a shingle in
    their prefixes of ``n - ceil(t n) + 1``; shingles that occur once fill
    prefix places but never need posting.
3.  Items with identical prefixes and size form a group.  Groups are posted at
    their prefix shingles; group pairs are filtered by size and by the largest
    overlap that their prefixes allow, and only those left are expanded to
    members.  Full sets decide.

Pairs are tried in two
rounds: each item with its group's first and, for the groups' firsts, with up to
``LEADERS`` leaders of their prefix shingles; then the expanded pairs of the group
join.  Where only components are asked for (``similar_components``,
``one_of_each``), the second round leaves out pairs that the first one put in one
component; ``similar_links`` makes them all.  One leader is the most central item,
that whose shingles occur in the most items: edited copies resemble their source
more than each other.  Components of families thus cost a few pairs per member,
their links as many pairs as there are.  Prefix shingles are posted by 32 of their
bits; two that agree in these only bring further candidates.

Both rounds also use odd sketches, ``SKETCH`` parity bits of each whole set:
two sketches differ in at most as many bits as the sets differ in shingles, so
a pair that differs in more is no link, whatever the sets hold.

Defined cases: null or wordless texts have empty sets and link with nothing;
null ids come last for component_id (null only if the whole component has
none); equal rows are one item and all returned; 64-bit hashes stand for
shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import maybe_broadcast, row_key, slices, written
from quillon.llm.components import components
from quillon.llm.linededup import hash_seed
from quillon.llm.shingles import shingle_sets

# Of 256 hash classes, those whose shingles are counted and ordered by rarity.
COUNTED = 51
LEADERS, SKETCH = 16, 1024
# Prefix shingles that a posting of the second round may list.
POSTED = 64


def _prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each of ``SKETCH`` bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _heads(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row identity, set_id, n, counted and filler shingles of each document."""
    def scan(batches):
        for b in slices(batches):
            ids, ns, counted, fill, odd = [], [], [], [], []
            for s in shingle_sets(b.column(2).to_pylist(), size):
                ids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                ns.append(len(s))
                first = (s & np.uint64(255)) < COUNTED
                counted.append(s[first].view(np.int64))
                more = max(0, _prefix_length(len(s), percent) - len(counted[-1])) if len(s) else 0
                fill.append(np.sort(s[~first].view(np.int64))[:more])
                odd.append(odd_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(ns, pa.int32()),
                 pa.array(counted, pa.list_(pa.int64())), pa.array(fill, pa.list_(pa.int64())),
                 pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "row", "set_id", "n", "counted", "fill", "odd"])

    heads = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(
        scan, "doc_id long, row long, set_id long, n int, counted array<long>, fill array<long>, odd array<long>")
    return written(heads.withColumn("uid", F.monotonically_increasing_id()), "heads")


def _prefixes(items: DataFrame, percent: int) -> DataFrame:
    """uid, n, prefix (32 bits of its shared shingles), rest (shingles that may
    lie behind it), sketch, central (mean log count of the counted shingles)."""
    posts = items.select("uid", F.explode(F.concat("counted", "fill")).alias("shingle"))
    often = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    late = F.col("shingle").bitwiseAND(F.lit(255)) >= COUNTED
    shared = (posts.join(often, "shingle").groupBy("uid")
              .agg(F.sort_array(F.collect_list(F.struct(late.alias("late"), "df", "shingle"))).alias("s")))
    early = F.filter("s", lambda x: ~x["late"])
    p = F.expr(f"n - ({percent} * n + 99) div 100 + 1").cast("int")
    alone = F.col("n_counted") - F.size("early")
    take = F.greatest(F.lit(0), F.col("p") - F.col("alone"))
    return (shared.join(items.select("uid", "n", F.size("counted").alias("n_counted"), "odd"), "uid")
            .withColumn("p", p).withColumn("early", early).withColumn("alone", alone)
            .withColumn("all", F.transform(F.concat(F.slice("early", F.lit(1), take), F.filter("s", lambda x: x["late"])),
                                           lambda x: F.shiftright(x["shingle"], 32).cast("int")))
            .withColumn("prefix", F.array_distinct("all"))
            .filter(F.size("prefix") > 0)
            .withColumn("logs", F.aggregate("early", F.lit(0.0), lambda t, x: t + F.log(x["df"].cast("double"))))
            .select("uid", "n", "prefix", (F.col("n") - F.col("p") + F.size("all") - F.size("prefix")).alias("rest"), "odd",
                    (F.col("logs") / F.greatest(F.lit(1), F.col("n_counted"))).alias("central")))


def _possible(percent: int, prefixes: bool = True):
    """Size and sketch bounds of two rows (a.., b..), and the overlap bound of
    their prefixes where they are at hand."""
    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    bits = [F.bit_count(F.get("oa", F.lit(i)).bitwiseXOR(F.get("ob", F.lit(i)))) for i in range(SKETCH // 64)]
    bound = ((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
             & (reduce(lambda x, y: x + y, bits) <= F.col("na") + F.col("nb") - 2 * need))
    return bound & (F.size(F.array_intersect("pa", "pb")) + F.greatest("ra", "rb") >= need) if prefixes else bound


def _linked(pairs: DataFrame, items: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of uids whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    wanted = written(items.join(ids, "uid").select(F.col("doc_id").alias("wanted"), "set_id", "uid", "n"), "wanted")
    who = written(wanted.select("wanted").distinct(), "who")

    def scan(batches):
        for b in slices(batches):
            sets = [s for s in shingle_sets(b.column(0).to_pylist(), size) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("binary").alias("text"))
    sets = (texts.join(maybe_broadcast(who), F.col("d").eqNullSafe(F.col("wanted")), "left_semi").select("text")
            .mapInArrow(scan, "set_id long, s array<long>"))
    sets = written(sets.join(wanted.select("set_id", "uid", "n"), "set_id").select("uid", "n", "s"), "sets")
    both = (pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b")
            .withColumn("common", F.size(F.array_intersect("sa", "sb"))))
    return written(both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
                   .select("a", "b").distinct(), "links")


def _joined(docs: DataFrame, size: int, percent: int, all_links: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heads, the sets (set_id, uid, first_id, root of the component) and the
    links (a, b) of the sets' uids: every one with ``all_links``, else as many as
    the components need."""
    heads = _heads(docs, size, percent)
    one = heads.filter("n > 0").groupBy("set_id").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first_id"))
    copies = written(heads.filter("n > 0").select("uid", "set_id").join(one.select("set_id", F.col("uid").alias("rep")), "set_id")
                     .filter("uid <> rep").select("uid"), "copies")
    items = heads.filter("n > 0").join(maybe_broadcast(copies), "uid", "left_anti")
    prefixes = written(_prefixes(items, percent).withColumn("gid", F.xxhash64("prefix", "n")), "prefixes")

    heads_of = prefixes.groupBy("gid").agg(F.min("uid").alias("b"))
    within = prefixes.select("gid", F.col("uid").alias("a")).join(heads_of, "gid").filter("a <> b").select("a", "b")
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))))
    # A shingle's leaders are its most central item (turn LEADERS) and the item
    # whose uid is nearest to one of LEADERS constants (by XOR), so that a family
    # is not tied to a single member.
    turn = F.pmod("shingle", F.lit(LEADERS)).cast("int")
    salt = F.element_at(F.array(*[F.lit(hash_seed(i) >> 1 & (1 << 62) - 1) for i in range(LEADERS)]), F.col("turn") + 1)
    reps = (prefixes.join(heads_of.withColumnRenamed("b", "uid"), ["gid", "uid"])
            .select("uid", "central", band.alias("band"), F.explode("prefix").alias("shingle")).withColumn("turn", turn).withColumn("salt", salt))
    leaders = (reps.groupBy("shingle", "band", "turn", "salt")
               .agg(F.min(F.col("uid").bitwiseXOR(F.col("salt"))).alias("m"), F.max_by("uid", F.struct("central", "uid")).alias("c"))
               .select("shingle", "band", F.explode(F.array(F.struct("turn", F.col("m").bitwiseXOR(F.col("salt")).alias("b")),
                                                            F.struct(F.lit(LEADERS).alias("turn"), F.col("c").alias("b")))).alias("l"))
               .select("shingle", "band", "l.turn", "l.b"))
    across = (reps.drop("turn").join(leaders, ["shingle", "band"]).filter("uid <> b").groupBy(F.col("uid").alias("a"), "turn", "b").count()
              .groupBy("a", "turn").agg(F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    side = prefixes.select("uid", "n", "prefix", "rest", "odd")
    tried = written(within.union(across).distinct().join(side.toDF("a", "na", "pa", "ra", "oa"), "a").join(side.toDF("b", "nb", "pb", "rb", "ob"), "b")
                    .filter(_possible(percent)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    links = _linked(tried, items, docs, size, percent)
    roots = components(links)

    # Items with different roots are in different components; for all links each
    # item counts as its own.
    if all_links:
        roots = roots.select("id", F.col("id").alias("root"))
    members = written(prefixes.select("uid", "gid", "n", "odd").join(roots.withColumnRenamed("id", "uid"), "uid", "left")
                      .withColumn("root", F.coalesce("root", "uid")), "members")
    # A group of one carries its sketch, so that its pairs need no expansion to
    # be told apart.
    spread = members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                        F.when(F.count(F.lit(1)) == 1, F.first("odd")).alias("odd"))
    groups = written(prefixes.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.max("rest").alias("rest"))
                     .join(spread, "gid"), "groups")
    placed = groups.select("gid", "lo", "hi", F.explode("prefix").alias("shingle"))
    split = placed.groupBy("shingle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("shingle")
    mixed = written(placed.select("gid", "shingle").join(split, "shingle"), "mixed")
    # Only short lists are posted along, so that a posting stays small; pairs of
    # longer ones may be made at several shingles and are told apart after.
    own = (mixed.groupBy("gid").agg(F.sort_array(F.collect_list("shingle")).alias("own"))
           .select("gid", F.when(F.size("own") <= POSTED, F.col("own")).alias("own")))
    posts = written(mixed.join(own, "gid").join(groups.select("gid", "n", "lo", "hi", "odd"), "gid")
                    .select("shingle", "gid", "n", "lo", "hi", "odd", "own"), "posts")
    a, b = posts.toDF("shingle", "ga", "na", "loa", "hia", "oa", "pa"), posts.toDF("shingle", "gb", "nb", "lob", "hib", "ob", "pb")
    once = F.coalesce(F.get(F.array_intersect("pa", "pb"), F.lit(0)) == a["shingle"], F.lit(True))
    apart = ((F.least("loa", "lob") != F.greatest("hia", "hib")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
             & (F.col("oa").isNull() | F.col("ob").isNull() | _possible(percent, False)))
    met = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("ga") > F.col("gb")) & apart & once).select("ga", "gb").distinct()
    ends = groups.select("gid", "n", "prefix", "rest")
    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    near = (met.join(ends.toDF("ga", "na", "pa", "ra"), "ga").join(ends.toDF("gb", "nb", "pb", "rb"), "gb")
            .filter(F.size(F.array_intersect("pa", "pb")) + F.greatest("ra", "rb") >= need).select("ga", "gb")
            .union(groups.filter("lo <> hi").select("gid", "gid")))
    # Group pairs that are left expand to their members.
    rest = (near.join(members.toDF("a", "ga", "na", "oa", "roota"), "ga").join(
        members.toDF("b", "gb", "nb", "ob", "rootb"), "gb")
        .filter((F.col("roota") != F.col("rootb")) & ((F.col("ga") != F.col("gb")) | (F.col("a") > F.col("b"))) & _possible(percent, False))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    rest = written(rest, "pairs")
    if not rest.isEmpty():
        links = links.union(_linked(rest, items, docs, size, percent))
    roots = components(links)

    return heads, one.join(roots.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")), links


def similar_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (the
    same for documents with equal sets, else different; null without words)."""
    heads, sets, _ = _joined(docs, size, percent, all_links=False)
    named = sets.groupBy("root").agg(F.min("first_id").alias("component_id"))
    sets = sets.join(named, "root").select(F.col("set_id").alias("s"), "component_id")
    full = heads.filter("n > 0").join(sets, F.col("set_id") == F.col("s"))
    n = F.col("n").cast("long").alias("n_shingles")
    return full.select("doc_id", n, "component_id", F.col("set_id").alias("class_id")).union(
        heads.filter("n = 0").select("doc_id", n, F.col("doc_id"), F.lit(None).cast("long")))


def similar_links(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(a, b), a < b: all links between different sets, as set ids."""
    _, sets, links = _joined(docs, size, percent, all_links=True)
    x, y = sets.select(F.col("uid").alias("a"), F.col("set_id").alias("x")), sets.select(F.col("uid").alias("b"), F.col("set_id").alias("y"))
    return links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null ids last),
    then row identity (doc_id and text); of rows equal in both one stays, picked
    by a hash of all columns.  Rows without words link with nothing and all stay;
    columns as given."""
    heads, sets, _ = _joined(docs, size, percent, all_links=False)
    rows = heads.filter("n > 0").groupBy("row").agg(F.min("set_id").alias("set_id"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
    placed = rows.join(sets.select("set_id", "root"), "set_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    heirs = placed.groupBy("root").agg(F.min(order)["row"].alias("heir"))
    # A row that stays and is given once needs no mark.
    marks = written(placed.join(heirs, "root").select("row", (F.col("row") == F.col("heir")).alias("stays"), "n_rows")
                    .filter("not stays or n_rows > 1").select(F.col("row").alias("__row"), F.col("stays").alias("__stays")), "marks")
    keyed, names = docs.withColumn("__row", row_key("doc_id", "text")), docs.columns
    single = keyed.join(maybe_broadcast(marks.select("__row")), "__row", "left_anti").select(*names)
    # Partial aggregate: a row repeated in a third of all rows is collapsed before the shuffle.
    again = (keyed.join(maybe_broadcast(marks.filter("__stays").select("__row")), "__row", "left_semi")
             .groupBy("__row").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__one")).select("__one.*"))
    return single.unionByName(again)
