"""Filter interaction audit: what each filter removes, at each step of each order in which filters can be applied.

Each document gets a mask of the filters it fails. Masks are unpivoted into cells against the steps of all orders; a
running bit-or over the steps before tells which cells an earlier filter has removed; conditional sums by step, and
window totals by filter, give the figures. Cells are counts of documents by part, mask and labels, so that what is held
against the orders does not grow with the documents.

The duplicate filter is told by digests of whole texts: rows of one digest are first counted by id and mask, then by mask
with their smallest id, so that no copies meet but as a few counts, and no text is shuffled.

Nulls: a null text is empty, a null source is the part ''; a null id is no smaller and no greater than any, so its row
neither is nor makes a duplicate, and has no labels. Rows that repeat an id and text are documents each, and no duplicates
of one another; a repeated id in `labels` counts as labelled if any of its rows is. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terragrid.llm.shared import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GOOD, TOXIC = 1, 2


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: A short, B repetitive, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """id and bits of the labels that any of its rows has."""
    bit = lambda c, b: F.when(F.max(c) == 1, b).otherwise(0)
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("bits"))


def failure_counts(
    df: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicate: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> tuple[DataFrame, str]:
    """(part, mask, bits, n: how many documents fail exactly the filters of the mask, by labels; letters of the bits of masks).

    `filters` are conditions by letter; `duplicate` is the letter of the filter that a smaller id's identical text fails.
    """
    letters = "".join(filters) + duplicate
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())])
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), mask.cast("int").alias("mask"))
    same = docs.groupBy("digest", "id", "part", "mask").count()
    marked = same.join(_labels(labels, id_col), F.col("id") == F.col("l_id"), "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    cells = marked.groupBy("digest", "part", "mask", "bits").agg(
        F.sum("count").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("count")).otherwise(0)).alias("loose"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "count"))).alias("low"),
    )
    first = F.col("low.id") == F.min("low.id").over(W.partitionBy("digest"))  # of a digest there is a row for each part, mask and labels
    kept = F.col("loose") + F.coalesce(F.when(first, F.col("low.count")), F.lit(0))
    both = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(filters)).alias("mask"), (F.col("n") - kept).alias("n")))
    split = cells.withColumn("both", both).select("part", "bits", F.explode("both").alias("c"))
    return split.where("c.n > 0").groupBy("part", "c.mask", "bits").agg(F.sum("c.n").alias("n")), letters


def order_effects(counts: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the figures of each step, of all orders of the letters' filters, zeros included.

    `counts` has part, mask, bits, n as `failure_counts` gives them.
    """
    orders = ["".join(p) for p in permutations(sorted(letters))]
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    long = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(steps))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1)"))
    cell = W.partitionBy("part", "filter_order", "mask", "bits").orderBy("step")
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumns({
        "fails": failed != 0,
        "gone": F.coalesce(F.bit_or(failed).over(cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) != 0,
    })
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    removed = F.col("fails") & ~F.col("gone")
    figures = long.groupBy("part", "filter_order", "step").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"),
        total(removed).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed & (F.col("bits").bitwiseAND(GOOD) != 0)).alias("good_lost"),
        total(removed & (F.col("bits").bitwiseAND(TOXIC) != 0)).alias("toxic_lost"),
    )
    by_filter = W.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return figures.withColumn("shapley", F.sum("removed").over(by_filter))


def audited(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the filters A to D of `text_filters` and E, identical to a smaller id's text, by source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts, letters = failure_counts(df, labels, text_filters(text), "E", id_col, text_col, part_col)
    return order_effects(cut_lineage(counts), letters)
