"""Ranks, running sums and carried values over a whole order, without gathering the rows in one task.

Rows are range-partitioned by the order and written with the number of their slice. A second level works on one row per slice
(and key): what lies before a slice, or what the slice before ended with. Slices then finish on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.sources.checkpoints import cut


def in_slices(rows: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """The rows with _slice: rows of a later slice come later in the order, and equal ones share a slice.

    Written once, so that every reader sees the same slices.
    """
    many = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(many, *order).withColumn("_slice", F.spark_partition_id()))


def sums_before(counts: DataFrame, order: str, values: list[str], slices: int | None = None) -> DataFrame:
    """Rows of distinct `order` values with before_<value>: the sum over all smaller ones."""
    sliced = in_slices(counts, [order], slices)
    totals = sliced.groupBy("_slice").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = totals.select("_slice", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(F.broadcast(offsets), "_slice").withColumns({
        f"before_{v}": F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).drop(
        "_slice", *[f"_{v}" for v in values])


def median(df: DataFrame, column: str, slices: int | None = None) -> DataFrame:
    """One row: the exact median of the values present (the mean of the middle two); null without any."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = sums_before(counts, "value", ["n"], slices).withColumn("_j", F.lit(1))
    total = counts.agg(F.sum("n").alias("total")).withColumn("_j", F.lit(1))
    middle = ranked.join(total, "_j")
    takes = lambda rank: (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    value = F.col("value")
    return middle.where(takes(low) | takes(high)).agg(
        ((F.max(F.when(takes(low), value)) + F.max(F.when(takes(high), value))) / 2).alias("median"))


def rank_auc(scored: DataFrame, score: str = "worthiness", label: str = "label", slices: int | None = None) -> DataFrame:
    """One row: the area under the ROC curve by rank sums, ties counted half; null if a class is absent."""
    one = F.col(label) == 1
    counts = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(one).alias("p"), F.count_if(~one).alias("n"))
    won = sums_before(counts, "score", ["n"], slices)
    return won.agg(F.try_divide(F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2)),
                                (F.sum("p") * F.sum("n")).cast("double")).alias("roc_auc"))
