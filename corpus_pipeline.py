"""Corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage works on all its predecessor kept, takes (spark, docs, sf_dir) and
returns a frame that is written and read again as the next one's documents.
All but the last return the columns of ``documents``.  When a stage begins, the
result of the one before has been written, so the intermediate tables behind
that result are deleted (those that the given documents still read stay).

SQL cannot express the first three stages (a trained sequence model, MinHash
bands, union-find), so ``ORACLE_SQL`` is None and ``tests/llm`` compares the
stages with brute force instead.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import linededup, mixing, ngramjoin, packing, quality
from quillon.llm.common import documents, dropped, noted, written
from quillon.llm.tokens import vocabulary_path
from quillon.sources.tables import read_table

#: Near duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


# Intermediate tables of the stage before.
_LEFT: list[tuple[str, str | None]] = []


def _stage(fn):
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = dropped(spark, _LEFT, docs)
        with noted() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    return run_stage


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality.train(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, model)


@_stage
def distinct_line_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has already."""
    return linededup.deduplicated(docs)


@_stage
def one_of_similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngramjoin.one_of_each(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


@_stage
def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the copies that the sources' target weights ask for."""
    return mixing.mixed_documents(docs)


@_stage
def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their training sequence and place in it."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_line_documents),
    ("near_duplicates", one_of_similar_documents),
    ("mix", mixed_documents),
    ("pack", packed_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
