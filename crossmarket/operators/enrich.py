"""Price-history context, volatility, trend and sentiment per market."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.config import EnrichmentConfig
from crossmarket.functions import text
from crossmarket.operators.ranks import in_slices

KEYS = ("market_id", "outcome")


def with_position(history: DataFrame, keys: tuple[str, ...] = KEYS,
                  tie: str = "event_id") -> DataFrame:
    """Points numbered from the newest back (rn = 1 is the last point)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc(tie))
    return history.withColumn("rn", F.row_number().over(newest))


def history_stats(history: DataFrame, keys: tuple[str, ...] = KEYS,
                  cfg: EnrichmentConfig = EnrichmentConfig()) -> DataFrame:
    """All figures of a series: whole-series aggregates joined to those of its last few points.

    The aggregates combine before the shuffle and the numbering is cut to the last points before
    it (group limit), so one very long series does not end up sorted in one task.
    """
    rn, price, volume = F.col("rn"), F.col("price"), F.col("volume")
    depth = max(cfg.price_points, cfg.recent_points, 3)
    last = with_position(history, keys).where(rn <= depth)
    recent = rn <= cfg.recent_points
    at = lambda i, c: F.max(F.when(rn == i, c))
    tail = last.groupBy(*keys).agg(
        F.avg(F.when(rn <= cfg.price_points, price)).alias("avg_recent_price"),
        at(1, price).alias("last_price"), at(3, price).alias("third_last_price"), at(1, volume).alias("last_volume"),
        F.max_by(F.when(recent, volume), F.when(recent, rn)).alias("recent_first_volume"),
        F.stddev_pop(F.when(recent, price)).alias("recent_volatility"))
    whole = history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(price, F.struct(F.col("timestamp"), F.col("event_id"))).alias("first_price"),
        F.stddev_pop(price).alias("price_volatility"), F.stddev_pop(volume).alias("volume_volatility"),
        F.min(price).alias("support_level"), F.max(price).alias("resistance_level"))
    return whole.join(tail, list(keys))


def historical_context(stats: DataFrame, current: Column | None = None,
                       cfg: EnrichmentConfig = EnrichmentConfig()) -> DataFrame:
    """Mean of the last prices, change of the current price against it, volume direction."""
    now = current if current is not None else F.col("last_price")
    mean = F.col("avg_recent_price")
    return stats.where(F.col("points") >= cfg.min_points).withColumn(
        "price_change_percentage", F.try_divide(now - mean, mean) * 100).withColumn(
        "volume_trend", F.when(F.col("last_volume") > F.col("recent_first_volume"), "increasing")
        .otherwise("decreasing"))


def volatility(stats: DataFrame, cfg: EnrichmentConfig = EnrichmentConfig()) -> DataFrame:
    spread = F.col("price_volatility")
    return stats.where(F.col("points") >= cfg.min_points).withColumns({
        "volatility_percentile": F.least(F.lit(0.95), spread * 10),
        "volatility_trend": F.when(F.round(F.col("recent_volatility") - spread, 9) > 0, "increasing")
        .otherwise("decreasing"),
        "risk_score": F.least(F.lit(1.0), (spread + F.col("volume_volatility")) / 2)})


def trend(stats: DataFrame) -> DataFrame:
    """Slope, direction, strength, momentum, support and resistance of at least three points."""
    slope = F.round((F.col("last_price") - F.col("first_price")) / F.col("points"), 9)
    strong = F.least(F.lit(1.0), F.abs(F.col("price_slope")) * 10)
    momentum = ((F.col("last_price") - F.col("third_last_price")) / 2 - F.col("price_slope")) / (
        F.abs(F.col("price_slope")) + 0.01)
    return (stats.where(F.col("points") >= 3).withColumn("price_slope", slope)
            .withColumn("price_trend", F.when(F.col("price_slope") > 0.01, "bullish")
                        .when(F.col("price_slope") < -0.01, "bearish").otherwise("sideways"))
            .withColumn("trend_strength", F.when(F.col("price_trend") == "sideways", 0.3).otherwise(strong))
            .withColumn("momentum_score", F.when(
                F.col("points") >= 5, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), momentum))).otherwise(0.0))
            .withColumn("trend_duration_hours", F.col("points") * 24))


def price_changes(observations: DataFrame, keys: tuple[str, ...] = KEYS, slices: int | None = None) -> DataFrame:
    """Observations whose price differs from the one before; the first is always kept.

    All observations are cut into slices of the order (series, time, id), so a long series, or a busy day of one, is spread over
    as many tasks as it needs. What the first observation of a slice follows is the last one of its series in an
    earlier slice, found among one row per series and slice.
    """
    order = [*keys, "timestamp", "event_id"]
    sliced = in_slices(observations, order, slices)
    inside = Window.partitionBy(*keys, "_slice").orderBy("timestamp", "event_id")
    ends = sliced.groupBy(*keys, "_slice").agg(F.max_by("price", F.struct("timestamp", "event_id")).alias("_end"))
    series = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.select(*keys, "_slice", F.lag("_end").over(series).alias("_carried"))
    compared = sliced.withColumn("_rn", F.row_number().over(inside)).withColumn("_lag", F.lag("price").over(inside))
    compared = compared.join(carried.toDF(*[f"_k{i}" for i in range(len(keys))], "_s", "_carried"),
                             (F.col("_slice") == F.col("_s")) & reduce(and_, (
                                 F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))))
    before = F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_lag"))
    return (compared.withColumn("previous_price", before).select(*observations.columns, "previous_price")
            .where(F.col("previous_price").isNull() | (F.col("price") != F.col("previous_price"))))


def with_sentiment(markets: DataFrame) -> DataFrame:
    return markets.withColumn("sentiment", text.sentiment(F.col("title"), F.col("description")))


def enrich(markets: DataFrame, history: DataFrame, market_key: str,
           cfg: EnrichmentConfig = EnrichmentConfig()) -> DataFrame:
    """Markets with sentiment and, where enough points exist, context, volatility and trend.

    History is reduced to one row per market before it meets the markets.
    """
    stats = history_stats(history, ("market_id",), cfg)
    context = historical_context(stats, cfg=cfg).select(
        "market_id", F.struct("avg_recent_price", "price_change_percentage", "volume_trend").alias("historical_context"))
    spread = volatility(stats, cfg).select("market_id", F.struct(
        "price_volatility", "volume_volatility", "volatility_percentile", "volatility_trend", "risk_score")
        .alias("volatility_metrics"))
    lines = trend(stats).select("market_id", F.struct(
        "price_trend", "trend_strength", "trend_duration_hours", "support_level", "resistance_level",
        "momentum_score").alias("trend_analysis"))
    extra = lines.join(context, "market_id", "full").join(spread, "market_id", "full")
    return with_sentiment(markets).join(extra, F.col(market_key) == F.col("market_id"), "left").drop("market_id")


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    label = lambda c, v: F.count_if(F.col(c) == v)
    return enriched.agg(
        F.count(F.lit(1)).alias("total_enriched_markets"),
        *[label("sentiment.label", v).alias(f"sentiment_{v}") for v in ("positive", "negative", "neutral")],
        *[label("trend_analysis.price_trend", v).alias(f"trend_{v}") for v in ("bullish", "bearish", "sideways")],
        F.coalesce(F.avg("volatility_metrics.risk_score"), F.lit(0.0)).alias("average_volatility_score"),
        F.count("sentiment").alias("with_sentiment"), F.count("volatility_metrics").alias("with_volatility"),
        F.count("trend_analysis").alias("with_trends"), F.count("historical_context").alias("with_history"))
