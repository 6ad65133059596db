"""Landing files: declared schemas, raw envelopes and response unwrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KALSHI_PAYLOAD = (
    "ticker string, id string, event_ticker string, title string, subtitle string, category string, "
    "status string, open_time string, close_time string, created_time string, yes_bid double, yes_ask double, "
    "no_bid double, no_ask double, last_price double, volume double, volume_24h double, liquidity double, "
    "open_interest bigint, can_close_early boolean")
POLYMARKET_PAYLOAD = (
    "id string, conditionId string, question string, title string, description string, category string, "
    "slug string, outcomes string, outcomePrices string, clobTokenIds string, lastTradePrice double, "
    "bestBid double, bestAsk double, volume string, volumeNum double, liquidity string, liquidityNum double, "
    "createdAt string, startDate string, startDateIso string, endDate string, endDateIso string, "
    "resolutionDate string, active boolean, closed boolean, archived boolean, tags string")
PAYLOADS = {"kalshi": KALSHI_PAYLOAD, "polymarket": POLYMARKET_PAYLOAD}
WRAPPERS = ("data", "items", "results", "markets")
CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """JSON-lines landing files of one venue under its declared schema; bad lines are kept aside."""
    return (spark.read.schema(f"{PAYLOADS[platform]}, {CORRUPT} string")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole response pages, one file per page, with the file they came from."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("page"), F.input_file_name().alias("file"))


def unwrap(pages: DataFrame, schema: str) -> DataFrame:
    """Records of response pages: a root array, or an object holding them under a known key."""
    rows = f"array<struct<{_struct_fields(schema)}>>"
    body = F.ltrim("page")
    root = F.when(body.startswith("["), F.from_json(body, rows))
    holder = F.from_json(body, ", ".join(f"{w} {rows}" for w in WRAPPERS))
    found = F.coalesce(root, *[holder[w] for w in WRAPPERS])
    return pages.select(F.explode(found).alias("_r")).select("_r.*")


def _struct_fields(schema: str) -> str:
    return ",".join(":".join(field.strip().split(" ", 1)) for field in schema.split(","))


def envelope(records: DataFrame, platform: str, key: Column, as_of: str, cap: int | None = None) -> DataFrame:
    """(platform, external_id, raw_data, fetched_at, processing_status); records without id are skipped."""
    rows = records.select(
        F.lit(platform).alias("platform"), key.alias("external_id"),
        F.to_json(F.struct(*[c for c in records.columns if c != CORRUPT])).alias("raw_data"),
        F.lit(as_of).cast("timestamp").alias("fetched_at"), F.lit("pending").alias("processing_status"))
    rows = rows.where(F.length(F.coalesce("external_id", F.lit(""))) > 0)
    return rows if cap is None else rows.limit(cap)


def kalshi_key() -> Column:
    return F.coalesce(F.nullif("ticker", F.lit("")), F.nullif("id", F.lit("")))


def polymarket_key() -> Column:
    return F.nullif("id", F.lit(""))


def with_event_category(markets: DataFrame, events: DataFrame) -> DataFrame:
    """Markets with the category of their parent event."""
    return markets.drop("category").join(events.select("event_ticker", "category"), "event_ticker")


def typed_quotes(df: DataFrame) -> DataFrame:
    """Numbers read leniently, missing is zero."""
    columns = ("volume", "volume_24h", "liquidity", "yes_bid", "yes_ask", "no_bid", "no_ask", "last_price")
    typed = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})
    return typed.withColumn("open_interest", F.coalesce(F.col("open_interest").try_cast("bigint"), F.lit(0))).withColumn(
        "can_close_early", F.coalesce("can_close_early", F.lit(False)))


def event_rollup(markets: DataFrame, active: Column) -> DataFrame:
    """Markets, active ones, high-volume ones and volume per event."""
    return markets.groupBy("event_ticker").agg(
        F.count(F.lit(1)).alias("markets_count"), F.count_if(active).alias("active_markets_count"),
        F.count_if(F.col("volume") > 100).alias("high_volume_count"), F.sum("volume").alias("total_volume"),
        F.max("volume").alias("max_volume"))


def field_overlap(left: DataFrame, right: DataFrame, column: str = "raw_data") -> DataFrame:
    """Field names of two payload tables: common, only left, only right."""
    names = lambda df: df.select(F.explode(F.json_object_keys(column)).alias("field")).distinct()
    a, b = names(left).withColumn("in_left", F.lit(True)), names(right).withColumn("in_right", F.lit(True))
    both = a.join(b, "field", "full")
    return both.select("field", F.when(F.col("in_left") & F.col("in_right"), "common").when(
        F.col("in_left"), "only_left").otherwise("only_right").alias("presence"))
