"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only.

Each source's documents are put in a random but repeatable order (md5 of the id and a seed) and queued up to `max_epochs`
times. A copy's virtual finish time is its source's cumulative size up to and with it, divided by the source's target.
All copies are sorted by that time and taken until the budget is used up, so that at any point of the mix the sources
stand to each other as their targets do.

A hot source does not meet in one task: running sums are taken in two levels, within ranges of the shuffled order and
over the ranges' totals. Only id, source and size are shuffled for the decision. `mixed_documents` then range-sorts the
taken copies by finish time, so that its partitions, and the files written of them, follow one another as the mix does.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null id is a value like others.
Rows that repeat id, source and size are decided together. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terragrid.llm.shared import cut_lineage

#: Rows that a range of the order holds on average.
RANGE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """source, source_size, target of (source, source_size): shares of the total by weight, at most max_epochs times the size.

    Sources by code point take the weights in turn, null last. What a stopped source leaves is shared among the others
    by weight: sources are stopped in the order of limit / weight for as long as the total would still be reached.
    The windows run over one row per source, not over documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1).cast("bigint")
    limit = F.col("source_size") * max_epochs
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    over = sizes.withColumn("weight", weight).withColumn("limit", limit)
    over = over.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()),
        "limits_before": F.coalesce(F.sum("limit").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weights_from": F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)),
    })
    level = F.col("limit") / F.col("weight")
    over = over.withColumn("stopped", F.col("limits_before").cast("double") + level * F.col("weights_from") <= F.col("total").cast("double"))
    free = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(W.partitionBy())
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("limit"))).over(W.partitionBy()), F.lit(0))
    share = left.cast("double") / free * F.col("weight")
    return over.select("source", "source_size", F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def _order() -> list[Column]:
    """Where a copy stands in the mix."""
    return [F.col("finish"), F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("size"), F.col("epoch")]


def _queued(df: DataFrame, weights: Sequence[int], max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(all units: id, source, size, n, source_size, target; the copies that the mix takes: id, source, size, key, epoch, finish)."""
    units = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    units = units.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    units = cut_lineage(units.withColumn("key", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"|{seed}")))))
    digits = max(1, math.ceil(math.log(max(units.count(), 1) / RANGE_ROWS + 1, 16)))
    units = units.withColumn("range", F.substring("key", 1, digits))
    sums = units.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    by_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sums.withColumn("offset", F.sum("words").over(upto) - F.col("words")).alias("o")
    offsets = offsets.join(by_source.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "range", "offset", "source_size", "target")
    within = W.partitionBy("u.source", "u.range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = (
        units.alias("u")
        .join(offsets.alias("o"), (F.col("u.range") == F.col("o.range")) & F.col("u.source").eqNullSafe(F.col("o.source")))
        .withColumn("upto", F.col("offset") + F.sum(F.col("size") * F.col("n")).over(within))
        .select("id", "u.source", "size", "n", "key", "source_size", "target", "upto")
    )
    queued = cut_lineage(queued)
    rounds = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.least(F.lit(max_epochs), F.ceil(F.col("target") / F.col("source_size")).cast("int")))
    copies = queued.where((F.col("size") > 0) & rounds.isNotNull()).withColumn("epoch", F.explode(F.sequence(F.lit(1), rounds)))
    finish = ((F.col("epoch") - 1) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    copies = copies.withColumn("finish", finish)
    budget = sums.agg(F.sum("words")).first()[0] or 0
    parts = max(1024, queued.count() // RANGE_ROWS)
    copies = copies.withColumn("part", F.floor(F.col("finish") * parts))
    along = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per part, not per document
    ends = copies.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("end", F.sum("words").over(along))
    last = ends.where(F.col("end") > budget).orderBy("part").select("part", (F.col("end") - F.col("words")).alias("before")).first()
    if last is None:  # the budget takes all copies
        taken = F.lit(True)
    else:
        order = W.partitionBy("part").orderBy(*_order()).rowsBetween(W.unboundedPreceding, W.currentRow)
        edge = copies.where(F.col("part") == last.part).withColumn("run", F.sum(F.col("size") * F.col("n")).over(order))
        edge = edge.where(F.col("run") <= budget - last.before)
        taken = F.col("part") < last.part
    names = ["id", "source", "size", "key", "epoch", "finish"]
    whole = copies.where(taken).select(*names)
    return queued, whole if last is None else whole.unionAll(edge.select(*names))


def mix(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of `df`: id, source, size, source_size, target, taken (size times the copies that the mix takes), finish (the
    virtual finish time of its first copy taken, null without one). Range-partitioned and sorted by finish, so in the mix's
    order; what the mix does not take comes last.
    """
    queued, taken = _queued(df, weights, max_epochs, seed, id_col, text_col, source_col)
    q, t = queued.alias("q"), taken.groupBy("id", "source", "size").agg(F.count("*").alias("copies"), F.min("finish").alias("finish")).alias("t")
    same = F.col("q.id").eqNullSafe(F.col("t.id")) & F.col("q.source").eqNullSafe(F.col("t.source")) & (F.col("q.size") == F.col("t.size"))
    order = [F.col("finish").asc_nulls_last(), F.col("q.source").asc_nulls_last(), F.col("key"), F.col("q.id"), F.col("q.size")]
    out = q.join(t, same, "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select(
        F.col("q.id").alias(id_col), F.col("q.source").alias(source_col), F.col("q.size").alias("size"), "source_size", "target", (F.col("q.size") * F.coalesce("copies", F.lit(0))).alias("taken"), "finish"
    )


def mixed_documents(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `df` that the mix takes, repeated as often as it takes them, in the mix's order: range-partitioned and sorted.

    Documents without words are not taken. Columns of any other names pass through.
    """
    _, taken = _queued(df, weights, max_epochs, seed, id_col, text_col, source_col)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    d = df.select(row.alias("row"), F.col(id_col).alias("d_id"), F.col(source_col).alias("d_source"), n_words(F.col(text_col)).alias("d_size")).where("d_size > 0")
    same = F.col("d_id").eqNullSafe(F.col("id")) & F.col("d_source").eqNullSafe(F.col("source")) & (F.col("d_size") == F.col("size"))
    return d.join(taken, same).repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("row.*")
