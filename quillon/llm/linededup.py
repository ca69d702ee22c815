"""Fuzzy line deduplication by MinHash.

Lines with a word are collapsed to distinct lines first.  A distinct line's
signature has ``BANDS * ROWS`` minima over all its character shingles, those that
verification compares, hashed in blocks of lines: XOR with a constant permutes the
64-bit hashes, and a permutation's minimum and maximum give two signature values.  Lines that share a band are
candidates; full character-shingle sets decide exactly (Jaccard of at least
``threshold``).  Union-find over the verified pairs gives classes, and the
first line of each class (by doc_id, then row identity, then position) stays.

No bucket is expanded to all its pairs: the first round compares each line
with two leaders in each of its buckets (one picked by hash, and the most
central one, that whose buckets are the fullest: edited lines resemble their
source more than each other), the second those pairs of a bucket that the first
one left in different classes.  Before shingles are compared, a pair must pass
the bound of its odd sketches: ``SKETCH`` parity bits of a line's whole shingle
set differ in at most as many bits as two sets differ in shingles, so a pair
that differs in more is none, and the bound loses nothing.

Hot lines: one line repeated in a third of all rows is collapsed by a partial
aggregate before anything is shuffled by line.  The distinct lines are a
bucketed table, so the joins for verification do not shuffle it again.

Defined cases: lines without a word always stay; null and empty text have no
lines to remove; lines shorter than a shingle match exact repeats only; rows
equal in doc_id and text count as one document and get the same result; null
ids come last when the first line of a class is picked.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import let_go, note, row_key, shuffle_partitions, slices, written
from quillon.llm.components import components
from quillon.llm.shingles import _powers, mix
from quillon.session import checkpoint_dir

SHINGLE, ROWS, BANDS, THRESHOLD = 10, 3, 8, 80
SKETCH = 1024
# Lines whose shingles are hashed together.
BLOCK_LINES = 500


def _lines(column: str = "text"):
    return F.split(F.coalesce(F.col(column), F.lit("")), "\n")


def _has_word(line):
    return F.btrim(line, F.lit(" \t\x0b\x0c\r")) != ""


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Bucketed table of (line_key, line, first), first being the place of the
    first occurrence."""
    spark = docs.sparkSession
    lines = (docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.posexplode(_lines()).alias("pos", "line"))
             .filter(_has_word(F.col("line")))
             .groupBy(F.xxhash64("line").alias("line_key"))
             .agg(F.min("line").alias("line"),
                  F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "pos")).alias("first")))
    name = f"lines_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    # Text that is read by parts only: smaller files are worth the time.
    lines.write.format("parquet").option("compression", "zstd").bucketBy(shuffle_partitions(spark), "line_key").option("path", path).saveAsTable(name)
    note(path, name)
    return spark.table(name)


def _gram_block(lines: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all character shingles of all lines, one from each character
    on, line after line, and how many each line has."""
    texts = [(t or b"").decode("utf-8", "replace") for t in lines]
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = np.maximum(length - shingle + 1, 0)
    if not n.sum():
        return np.empty(0, dtype=np.uint64), n
    place = _powers(shingle)
    grams = code[:len(code) - shingle + 1] * place[0]
    for k in range(1, shingle):
        grams += code[k:len(code) - shingle + 1 + k] * place[k]
    # Those that begin in one line and end in the next are left out.
    starts, before = np.cumsum(length) - length, np.cumsum(n) - n
    return mix(grams[np.arange(n.sum()) + np.repeat(starts - before, n)]), n


def _distinct_grams(lines: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    grams, n = _gram_block(lines, shingle)
    return [np.unique(x) for x in np.split(grams, np.cumsum(n)[:-1])] if len(n) else []


def signatures(lines: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(line_key, bands): the hashes of each band of ``rows`` minima, for the
    lines with a shingle."""
    values = rows * bands
    seeds = [np.uint64(hash_seed(i) + (1 << 63)) for i in range(-(-values // 2))]

    def scan(batches):
        for b in slices(batches, BLOCK_LINES):
            grams, n = _gram_block(b.column(1).to_pylist(), shingle)
            at = (np.cumsum(n) - n)[n > 0]
            if not len(at):
                continue
            mins = []
            for seed in seeds:
                x = grams ^ seed
                mins += [np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)]
            keys = np.empty((len(at), bands), dtype=np.uint64)
            for k in range(bands):
                band = np.full(len(at), k + 1, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band * _powers(2)[1] + mins[k * rows + r])
                keys[:, k] = band
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(n > 0)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))], ["line_key", "bands"])

    return lines.select("line_key", F.col("line").cast("binary").alias("line")).mapInArrow(scan, "line_key long, bands array<long>")


def buckets(lines: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(b, band, line_key, n) of the lines that share a band with another, n
    being the lines of the band."""
    return (signatures(lines, shingle, rows, bands).select("line_key", F.posexplode("bands").alias("b", "band"))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band")))
            .filter("n > 1"))


def led(shared: DataFrame, bands: int) -> DataFrame:
    """Pairs (a, b) of each line with its buckets' leaders.  The leader by hash is
    nearest to a constant of the band's number, so that a family of lines is not
    tied to a single member."""
    salt = F.element_at(F.array(*[F.lit(hash_seed(100 + b)) for b in range(bands)]), F.col("b") + 1)
    central = shared.groupBy("line_key").agg(F.sum(F.log("n")).alias("central"))
    leaders = (shared.join(central, "line_key").withColumn("salt", salt).groupBy("band", "salt")
               .agg(F.min(F.col("line_key").bitwiseXOR(F.col("salt"))).alias("m"), F.max_by("line_key", F.struct("central", "line_key")).alias("c"))
               .select("band", F.explode(F.array_distinct(F.array(F.col("m").bitwiseXOR(F.col("salt")), F.col("c")))).alias("leader")))
    return (shared.join(leaders, "band").filter("line_key <> leader")
            .select(F.greatest("line_key", "leader").alias("a"), F.least("line_key", "leader").alias("b")).distinct())


def hash_seed(i: int) -> int:
    """Well spread signed 64-bit constants."""
    return ((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63)


def sketches(lines: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(line_key, size, odd): shingle count and odd sketch of the asked lines
    with a shingle."""
    def scan(batches):
        for b in slices(batches, BLOCK_LINES):
            sets = _distinct_grams(b.column(1).to_pylist(), shingle)
            odd = [np.packbits((np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) % 2).astype(np.uint8)).view(np.int64) for s in sets]
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(odd, pa.list_(pa.int64()))], ["line_key", "size", "odd"])
            yield out.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return (lines.join(keys, "line_key", "left_semi").select("line_key", F.col("line").cast("binary").alias("line"))
            .mapInArrow(scan, "line_key long, size int, odd array<long>"))


def _possible(threshold: int):
    """Size and sketch bounds of two rows (na, oa) and (nb, ob)."""
    need = F.expr(f"({threshold} * (na + nb) + {99 + threshold}) div {100 + threshold}")
    bits = [F.bit_count(F.get("oa", F.lit(i)).bitwiseXOR(F.get("ob", F.lit(i)))) for i in range(SKETCH // 64)]
    return ((100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
            & (reduce(lambda x, y: x + y, bits) <= F.col("na") + F.col("nb") - 2 * need))


def verified(pairs: DataFrame, lines: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    def scan(batches):
        for batch in slices(batches, BLOCK_LINES):
            p, q = (_distinct_grams(batch.column(k).to_pylist(), shingle) for k in (2, 3))
            keep = []
            for x, y in zip(p, q):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = lines.select("line_key", F.col("line").cast("binary").alias("line"))
    x, y = text.toDF("a", "line_a"), text.toDF("b", "line_b")
    return (pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "line_a", "line_b")
            .mapInArrow(scan, "a long, b long"))


def line_classes(lines: DataFrame, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS,
                 threshold: int = THRESHOLD) -> DataFrame:
    """(id, root) of the distinct lines that have a similar one.

    Every step is written; the shuffle files of the steps before are let go."""
    spark = lines.sparkSession
    let_go(spark)
    shared = written(buckets(lines, shingle, rows, bands), "bands")
    let_go(spark)
    known = written(sketches(lines, shared.select("line_key").distinct(), shingle), "sketches")
    tried = (led(shared, bands).join(known.toDF("a", "na", "oa"), "a").join(known.toDF("b", "nb", "ob"), "b")
             .filter(_possible(threshold)).select("a", "b"))
    tried = written(tried, "pairs")
    let_go(spark)
    star = written(verified(tried, lines, shingle, threshold), "links")
    let_go(spark)
    first = components(star)
    placed = shared.join(first.withColumnRenamed("id", "line_key"), "line_key", "left").select(
        "band", "line_key", F.coalesce("root", "line_key").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    placed = written(placed.join(mixed, "band"), "mixed")
    # At most ``bands`` numbers a line.
    own = placed.groupBy("line_key").agg(F.sort_array(F.collect_set("band")).alias("own"))
    posts = written(placed.join(own, "line_key").join(known, "line_key").select("band", "line_key", "root", "own", "size", "odd"), "posts")
    let_go(spark)
    x, y = posts.toDF("band", "a", "ra", "ba", "na", "oa"), posts.toDF("band", "b", "rb", "bb", "nb", "ob")
    # A pair is made once, in the first band that it shares.
    once = F.get(F.array_intersect("ba", "bb"), F.lit(0)) == x["band"]
    rest = (x.join(y, (x["band"] == y["band"]) & (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & _possible(threshold) & once)
            .select("a", "b").join(tried, ["a", "b"], "left_anti"))
    more = written(verified(rest, lines, shingle, threshold), "links")
    return components(star.union(more)) if not more.isEmpty() else first


def kept_lines(docs: DataFrame, **params) -> DataFrame:
    """(row, kept): positions of the lines that stay, for each row identity
    that keeps a line with a word."""
    lines = distinct_lines(docs)
    classes = line_classes(lines, **params)
    own = lines.select("line_key", "first").join(classes.withColumnRenamed("id", "line_key"), "line_key", "left")
    alone = own.filter("root is null").select("first")
    heads = own.filter("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first")
    return alone.union(heads).groupBy(F.col("first.row").alias("row")).agg(F.sort_array(F.collect_list("first.pos")).alias("kept"))


def line_report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the kept positions."""
    kept = kept_lines(docs, **params)
    counts = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.size(F.filter(_lines(), _has_word)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return (counts.join(kept, "row", "left").withColumn("kept", F.coalesce("kept", none))
            .select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.col("kept").alias("kept_lines")))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The documents without the removed lines; columns as given, an
    ``n_chars`` column follows the text.  Documents are kept even if empty."""
    kept = kept_lines(docs, **params).select(F.col("row").alias("__row"), F.col("kept").alias("__kept"))
    lines = _lines()
    blanks = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: ~_has_word(F.get("__lines", i)))
    stay = F.array_sort(F.concat(F.coalesce("__kept", F.array().cast("array<int>")), "__blanks"))
    text = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    out = (docs.withColumn("__row", row_key("doc_id", "text")).join(kept, "__row", "left")
           .withColumn("__lines", lines).withColumn("__blanks", blanks)
           .withColumn("text", F.when(F.col("text").isNotNull(), text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
