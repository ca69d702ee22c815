"""Distributed union-find: connected components of an edge table.

Each round hooks every node to the smallest label among its neighbours and
then halves the label paths (label := label of the label).  Both steps are
joins and partial aggregates on the node id; nothing reaches the driver but
one changed-rows count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(id, root)`` for every node of ``edges``; root is the smallest id of
    its component.  Null ends are ignored, loops and repeated edges allowed."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    both = written(e.union(e.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id"))
                     .agg(F.least(F.min("b"), F.col("id")).alias("root")), "labels")
    while True:
        # Smallest label among the neighbours, offered to the node's root too,
        # so that whole trees move and not only their border.
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("r")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("r").alias("m"))
                .join(labels, "id"))
        offer = (near.select("id", F.least("m", "root").alias("r"))
                 .union(near.select(F.col("root").alias("id"), F.least("m", "root").alias("r")))
                 .groupBy("id").agg(F.min("r").alias("r")))
        hooked = (labels.join(offer, "id", "left")
                  .select("id", F.col("root").alias("old"),
                          F.least("root", F.coalesce("r", "root")).alias("root")))
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = written(hooked.join(up, "root", "left")
                      .select("id", "old", F.coalesce("top", "root").alias("root")), "labels")
        labels = new.select("id", "root")
        if new.filter("old <> root").isEmpty():
            return labels
