"""Vocabulary and TF-IDF operators.

The vocabulary is a top-N list (N is a parameter, 50 by default), so it is
the one frame whose size is bounded by a parameter rather than by the data;
it is the only thing broadcast here and the only thing that may be brought to
the driver (to turn positions into fixed-length arrays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

DEFAULT_TOP_N = 50


def event_counts(events: DataFrame, subject: str = "subject_id",
                 key: str = "item_id") -> DataFrame:
    """A4: rows per (subject, key).  Partial aggregation runs map-side."""
    return events.groupBy(subject, key).agg(F.count(F.lit(1)).alias("raw_count"))


def document_frequency(events: DataFrame, subject: str = "subject_id",
                       key: str = "item_id") -> DataFrame:
    """A5: distinct subjects per key.

    Expressed as distinct (key, subject) then count, which Spark plans as
    two partial-aggregated hash aggregates; a key held by a third of all
    rows is pre-reduced per map partition before the shuffle.
    """
    return (events.select(key, subject).distinct()
            .groupBy(key).agg(F.count(F.lit(1)).alias("subject_count")))


def top_n_vocabulary(df_counts: DataFrame, n: int = DEFAULT_TOP_N,
                     key: str = "item_id", count_col: str = "subject_count") -> DataFrame:
    """Top-N keys by count, ties broken by key ascending; ``pos`` is 0-based.

    A global ``orderBy().limit()`` plans as TakeOrderedAndProject (each
    partition keeps N rows, one task merges them).
    """
    top = df_counts.orderBy(F.col(count_col).desc(), F.col(key).asc()).limit(n)
    w = Window.orderBy(F.col(count_col).desc(), F.col(key).asc())
    # The window runs over at most n rows (after the limit).
    return top.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def smoothed_idf(vocab: DataFrame, total_subjects: F.Column | int,
                 count_col: str = "subject_count") -> DataFrame:
    """T4: idf = ln((N + 1) / (df + 1))."""
    total = total_subjects if isinstance(total_subjects, F.Column) else F.lit(total_subjects)
    return vocab.withColumn(
        "idf", F.log((total.cast("double") + 1.0) / (F.col(count_col).cast("double") + 1.0)))


def tfidf_weights(counts: DataFrame, idf: DataFrame, key: str = "item_id") -> DataFrame:
    """J3 + T3: inner join of (subject, key, raw_count) to the vocabulary IDF.

    The vocabulary side is bounded by N, so it is broadcast; the large
    side is never shuffled for this join.
    """
    v = F.broadcast(idf.select(key, "pos", "idf"))
    return (counts.join(v, key)
            .withColumn("tf", F.log1p(F.col("raw_count").cast("double")))
            .withColumn("tfidf", F.col("tf") * F.col("idf")))


def vocabulary_tfidf(events: DataFrame, spine: DataFrame, n: int = DEFAULT_TOP_N,
                     subject: str = "subject_id", key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Slice 1: events -> document frequency -> top-N -> TF-IDF per (subject, key).

    Returns (vocabulary with idf, weights).  N (total subjects) is the spine
    count, planned as a scalar subquery so that no driver round trip is needed.
    """
    df = document_frequency(events, subject, key)
    vocab = top_n_vocabulary(df, n, key)
    total = spine.agg(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    vocab_idf = smoothed_idf(vocab, total)
    weights = tfidf_weights(event_counts(events, subject, key), vocab_idf, key)
    return vocab_idf, weights
