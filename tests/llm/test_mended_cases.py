"""Cases that earlier versions got wrong: repeated phrases, shares of equal rows,
vectors of other lengths, training on whole texts."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import licenses, mixing, permutation, quality

APACHE = next(t for t, label in licenses.NOTICES if label == "apache-2")
MIT = next(t for t, label in licenses.NOTICES if label == "mit")


@pytest.mark.parametrize("text, labels", [
    ("you may not " * 30, ""),
    ("this is " + APACHE + " and more", "apache-2"),
    (APACHE.replace("except in compliance", "but only in full compliance") + " thanks", "apache-2"),
    (" ".join(reversed(APACHE.split())), ""),
    ("licensed under the apache " * 8, ""),
    (MIT + " x " * 50 + APACHE, "apache-2,mit"),
    ((APACHE + " ") * 3, "apache-2"),
])
def test_labels_of_the_method(spark, text, labels):
    rows = licenses.license_report(spark.createDataFrame([(1, text), (1, text), (2, "plain words only")], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.labels) for r in rows) == Counter([(1, labels), (1, labels), (2, "")])
    assert all(0 <= r.score <= 1 and (r.score >= licenses.MIN_SHARE) == bool(r.labels) for r in rows if not r.base_labels)


def test_mix_holds_exactly_the_planned_words(spark):
    rows = [(5, "one two three four five", "a", 1)] * 300 + [(k, "word " * (k % 9 + 1), "ab"[k % 2], 2) for k in range(100, 498)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    planned = mixing.fair_mix(docs).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    mixed = mixing.mixed_documents(docs)
    held = mixed.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert held == planned and mixed.columns == docs.columns
    per = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per[5] <= 600 and all(n <= 2 for i, n in per.items() if i != 5)


def test_vectors_of_other_lengths_are_searched(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4 if k % 3 else 2)]) for k in range(80)]
    got = permutation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probe=128, keep=1.0).collect()
    full = {k: np.array(v + [0.0] * (4 - len(v))) for k, v in rows}
    for q in range(0, 80, 20):
        want = sorted(((-float(full[q] @ v), k) for k, v in full.items() if k != q))[:20]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [k for _, k in want]


def test_training_reads_long_documents_and_late_lines(spark):
    rng = np.random.default_rng(7)
    calm = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    good = "\n".join(" ".join(calm(9)) for _ in range(60))
    late = "\n".join([" ".join(calm(9)) for _ in range(60)] + [f"BUY!!! $$$ | # * {' '.join(calm(2))} <now>" for _ in range(4000)])
    assert len(late) > 100_000
    docs = spark.createDataFrame([(k, good if k % 2 else late) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model["trans"] != [[0.0, 0.0], [0.0, 0.0]]
    kept = {r.doc_id: r.kept for r in quality.rated(docs, model).collect()}
    assert all(kept[k] == bool(k % 2) for k in range(12))
