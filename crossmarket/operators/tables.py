"""Table maintenance as DataFrame algebra: upserts, replacements, retention and repairs.

Each function takes the current table and the change and returns the next table (or the rows
to append); writing is left to the sinks. Works on any file format, without a table format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.functions import categories, prices


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key: one aggregation, so a hot key is combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_n_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)


def insert_or_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: source rows with a new key, one per key."""
    return source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def insert_or_replace(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target with source rows replacing equal keys; within one batch the newest row wins."""
    newest = latest_per_key(source, keys, order)
    return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str],
           values: list[str]) -> DataFrame:
    """Target after an upsert of `values`, with an action column: inserted, updated or kept.

    Columns outside `values` keep the target's content on update.
    """
    newest = latest_per_key(source, keys, order).withColumn("_s", F.lit(True))
    old, new = target.withColumn("_t", F.lit(True)).alias("t"), newest.alias("s")
    both = old.join(new, keys, "full")
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in values:
            columns.append(F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_t"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    action = (F.when(F.col("_t").isNull(), "inserted").when(F.col("_s"), "updated").otherwise("kept"))
    return both.select(*columns, action.alias("action"))


def upsert_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if(F.col("action") != "kept").alias("total"),
                      F.count_if(F.col("action") == "inserted").alias("inserted"),
                      F.count_if(F.col("action") == "updated").alias("updated"))


def price_log(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Price-history rows of an upsert: new markets' prices and every changed price."""
    before = target.select(*keys, F.col("yes_price").alias("_old"), F.lit(True).alias("_known"))
    joined = source.join(before, keys, "left")
    changed = F.col("_known").isNull() | ~F.col("yes_price").eqNullSafe(F.col("_old"))
    return joined.where(changed).select(
        *keys, F.lit("yes").alias("outcome"), F.col("yes_price").alias("price"), "volume",
        F.col("_known").isNull().alias("is_first"))


def replace_active(target: DataFrame, source: DataFrame, status: str = "active") -> DataFrame:
    """Drops every row of the given status and adds the new ones."""
    return target.where(~F.col("status").eqNullSafe(F.lit(status))).unionByName(source)


def retention(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows still inside the retention window."""
    return df.where(F.col(column).cast("timestamp") >= F.lit(as_of).cast("timestamp")
                    - F.make_dt_interval(F.lit(days)))


def retention_counts(df: DataFrame, column: str, as_of: str, days: int, name: str) -> DataFrame:
    old = F.col(column).cast("timestamp") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return df.agg(F.lit(name).alias("table_name"), F.count_if(old).alias("deleted"),
                  F.count_if(~old).alias("kept"))


def repair_kalshi_prices(df: DataFrame) -> DataFrame:
    """Cents become shares; then a No price that does not complement Yes is recomputed."""
    mine = F.col("platform") == "kalshi"
    scaled = df
    for c in ("yes_price", "no_price"):
        scaled = scaled.withColumn(c, F.when(mine, prices.cents_to_share(F.col(c))).otherwise(F.col(c)))
    off = F.round(F.abs(F.col("yes_price") + F.col("no_price") - 1.0), 9) > 0.01
    return scaled.withColumn("no_price", F.when(mine & off, 1.0 - F.col("yes_price")).otherwise(F.col("no_price")))


def repair_no_prices(df: DataFrame) -> DataFrame:
    """Second venue: missing No prices, then sums off by more than 0.1."""
    mine = (F.col("platform") == "polymarket") & F.col("yes_price").between(0, 1)
    missing = F.col("no_price").isNull() | (F.col("no_price") == 0)
    first = df.withColumn("no_price", F.when(mine & missing, 1.0 - F.col("yes_price")).otherwise(F.col("no_price")))
    off = F.round(F.abs(F.col("yes_price") + F.col("no_price") - 1.0), 9) > 0.1
    return first.withColumn("no_price", F.when(mine & off, 1.0 - F.col("yes_price")).otherwise(F.col("no_price")))


def repair_volumes(df: DataFrame) -> DataFrame:
    proxy = prices.volume_proxy(F.col("volume"), F.lit(None), F.col("liquidity"), "if_zero")
    return df.withColumn("volume", F.when(F.col("platform") == "kalshi", proxy).otherwise(F.col("volume")))


def repair_default_prices(df: DataFrame) -> DataFrame:
    """Certain or missing prices become even; then No is made the complement."""
    edge = F.col("yes_price").isNull() | F.col("yes_price").isin(0.0, 1.0)
    even = df.withColumn("no_price", F.when(edge, 0.5).otherwise(F.col("no_price"))).withColumn(
        "yes_price", F.when(edge, 0.5).otherwise(F.col("yes_price")))
    off = F.round(F.abs(F.col("yes_price") + F.col("no_price") - 1.0), 9) > 0.01
    return even.withColumn("no_price", F.when(off, 1.0 - F.col("yes_price")).otherwise(F.col("no_price")))


def repair_categories(df: DataFrame, wide: bool = False) -> DataFrame:
    fixed = categories.repaired_first(F.col("category"), F.col("title"), F.col("description"), wide)
    return df.withColumn("category", F.when(F.col("platform") == "polymarket", fixed).otherwise(F.col("category")))


def override_categories(df: DataFrame) -> DataFrame:
    return df.withColumn("category", categories.repaired_last(F.col("category"), F.col("title")))


def repair_descriptions(unified: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw descriptions copied onto unified rows by id, where there is one."""
    source = raw.select("id", F.col("description").alias("_raw"))
    return unified.join(source, "id", "left").withColumn(
        "description", F.coalesce("_raw", "description")).drop("_raw")


def seed_platforms(existing: DataFrame, seed: DataFrame) -> DataFrame:
    return existing.unionByName(seed.join(existing.select("name"), "name", "left_anti"))


def patch(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Non-NULL columns of the change table replace those of the row with the same key."""
    fresh = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c != key])
    joined = df.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if f"_n_{c}" in fresh.columns else F.col(c)
                           for c in df.columns])
