"""Line shingles hashed in blocks: exact sets, no regular expression per character."""

from pyspark.sql import functions as F

from quillon.llm import linededup as LD

LINES = ["", "short", "exactly 10", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dig",
         "😀 smile at the quick brown 😀 fox and the lazy dög", "aaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog!",
         "a completely different line of words", "no more of that"]


def _set(t):
    return {t[i:i + LD.SHINGLE] for i in range(len(t) - LD.SHINGLE + 1)}


def test_sets_sketches_and_pairs_are_exact(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_key long, line string").repartition(2)
    sizes = {r.line_key: r.size for r in LD.sketches(lines, lines.select("line_key"), LD.SHINGLE).collect()}
    assert sizes == {k: len(_set(t)) for k, t in enumerate(LINES) if _set(t)}
    pairs = spark.range(len(LINES)).crossJoin(spark.range(len(LINES)).toDF("b")).toDF("a", "b").filter("a > b and b > 1")
    got = {(r.a, r.b) for r in LD.verified(pairs, lines, LD.SHINGLE, 80).collect()}
    sets = [_set(t) for t in LINES]
    assert got == {(a, b) for a in range(len(LINES)) for b in range(2, a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert (4, 3) in got


def test_signatures_are_hashed_in_blocks(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)) + [(100, LINES[6] * 3)], "line_key long, line string")
    signed = LD.signatures(lines, LD.SHINGLE, LD.ROWS, LD.BANDS)
    rows = {r.line_key: r.bands for r in signed.collect()}
    assert rows.keys() == {k for k, t in enumerate(LINES) if _set(t)} | {100}
    assert all(len(x) == LD.BANDS for x in rows.values())
    assert rows[6] == rows[100] and rows[6] != rows[8]
    assert set(rows[3]) & set(rows[7])
    assert "regexp" not in signed._jdf.queryExecution().optimizedPlan().toString()
    assert signed.select(F.explode("bands")).distinct().count() > LD.BANDS
