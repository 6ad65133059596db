"""Equi-joins that stay balanced when one key holds a large share of the rows.

The quadratic part of this package is comparing two venues' listings. Three devices keep it
within bounds without dropping any result:

* range conditions (close times, volume ratio) become cells of the join key;
* keys whose pair count exceeds a budget are cut into a grid of slices on both sides;
* top-k pair reports only join the rows that can still reach the top k.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR_BUDGET = 25_000_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join over the full number of shuffle partitions.

    The work here is in the pairs, not in the bytes read. Left alone, adaptive execution would
    merge small inputs into few partitions and compare them on few cores.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys)


def sliced_sides(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                 budget: int = PAIR_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Both sides with slice numbers _r and _c, so that every pair of a key meets exactly once on (keys, _r, _c).

    Both sides are counted per key first (map-side combined). A hot key becomes r x c slices:
    a row keeps one slice number of its own side and is repeated for each slice of the other, so
    no slice has more than about `budget` pairs of one key.

    The table of hot keys is joined without a broadcast hint: it is small in practice, but grows
    with the data in principle, so its size is left to be measured at run time (adaptive joins).
    """
    edge = int(math.sqrt(budget))
    hot = (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
           .join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
           .where(F.col("_nl") * F.col("_nr") > budget)
           .select(*keys, F.ceil(F.col("_nl") / edge).alias("_rows"),
                   F.ceil(F.col("_nr") / edge).alias("_cols")))

    def sliced(df: DataFrame, own: str, other: str, own_slice: str, other_slice: str, id_col: str):
        count = lambda c: F.coalesce(F.col(c), F.lit(1)).cast("int")
        return (df.join(hot, keys, "left")
                .withColumn(own_slice, F.pmod(F.xxhash64(id_col), count(own)).cast("int"))
                .withColumn(other_slice, F.explode(F.sequence(F.lit(0), count(other) - 1)))
                .drop("_rows", "_cols"))

    return sliced(left, "_rows", "_cols", "_r", "_c", left_id), sliced(right, "_cols", "_rows", "_c", "_r", right_id)


def slice_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
               condition: Column | None = None, budget: int = PAIR_BUDGET) -> DataFrame:
    """Inner join on keys; keys with more than `budget` pairs run as a grid of smaller joins (see sliced_sides)."""
    a, b = sliced_sides(left, right, keys, left_id, right_id, budget)
    joined = spread_join(a, b, [*keys, "_r", "_c"])
    if condition is not None:
        joined = joined.where(condition)
    return joined.drop("_r", "_c")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, after every filter that does not need them.

    Filters on plain columns are copied into the join below, where an expensive measure would be evaluated on every
    candidate and again for each use. A generated column stays where it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_cell(df: DataFrame, name: str, value: Column, width: float, spread: bool) -> DataFrame:
    """Cell number of a value; the spread side also joins the two neighbouring cells.

    Two values at most `width` apart always meet, because their cells differ by at most one.
    """
    cell = F.floor(value / width)
    if spread:
        return df.withColumn(name, F.explode(F.array(cell - 1, cell, cell + 1)))
    return df.withColumn(name, cell)


def window_keys(df: DataFrame, epoch: Column, volume: Column, max_days: int | None,
                min_ratio: float | None, spread: bool) -> tuple[DataFrame, list[str]]:
    """Join-key cells for 'close within max_days' and 'volume ratio at least min_ratio'."""
    keys = []
    if max_days is not None:
        df = with_cell(df, "_t", epoch, float(max_days * 86400), spread)
        keys.append("_t")
    if min_ratio is not None:
        # Slightly wider than needed, so rounding of log10 cannot part a borderline pair.
        df = with_cell(df, "_v", F.log10(volume), -math.log10(min_ratio) * 1.0001, spread)
        keys.append("_v")
    return df, keys


def extreme_rows(df: DataFrame, keys: list[str], price: str, volume: str, row_id: str,
                 k: int) -> DataFrame:
    """Per key, the k lowest and k highest priced rows (larger volume, smaller id first).

    Enough for the k largest price gaps: a pair using any other row is beaten by k pairs that
    swap it for one of these. A row without a price has no gap, so it takes no place among them. The
    group limit runs before the shuffle, so hot keys stay small.
    """
    df = df.where(F.col(price).isNotNull())
    tie = [F.col(volume).desc(), F.col(row_id).asc()]
    low = Window.partitionBy(*keys).orderBy(F.col(price).asc(), *tie)
    high = Window.partitionBy(*keys).orderBy(F.col(price).desc(), *tie)
    bottom = df.withColumn("_rn", F.row_number().over(low)).where(F.col("_rn") <= k)
    top = df.withColumn("_rn", F.row_number().over(high)).where(F.col("_rn") <= k)
    return bottom.unionByName(top).drop("_rn").dropDuplicates([*keys, row_id])


def largest_gap_pairs(left: DataFrame, right: DataFrame, keys: list[str], k: int,
                      left_cols: tuple[str, str, str], right_cols: tuple[str, str, str]) -> DataFrame:
    """All pairs per key that can be among the k largest price gaps.

    The column triples name price, volume and id of each side.
    """
    a = extreme_rows(left, keys, *left_cols, k)
    b = extreme_rows(right, keys, *right_cols, k)
    return a.join(b, keys)
