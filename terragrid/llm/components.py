"""Connected components of an edge table, by hooking and contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of the columns a and b: label is the smallest id of its component.

    Each round hooks a node onto its smallest neighbour, follows the hooks to their roots by doubling, and keeps only the
    edges between different roots. The edges shrink at least by half in their nodes each round. Nulls and loops are
    dropped; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(b.alias("a"), a.alias("b")))
        roots = stored(both.groupBy(a.alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("root")))
        while True:
            onto = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
            step = stored(roots.join(onto, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            roots = step.select("id", "root")
            if step.where("moved").isEmpty():
                break
        to = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        edges = edges.join(to, "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("ra != rb")
        edges = stored(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if labels is None:
            labels = roots.select("id", F.col("root").alias("label"))
        else:
            old = labels.select("id", F.col("label").alias("at"))
            labels = old.join(roots.select(F.col("id").alias("at"), "root"), "at", "left").select("id", F.coalesce("root", "at").alias("label"))
    if labels is None:
        return edges.select(a.alias("id"), b.alias("label"))
    return stored(labels)
