"""Stateless and aggregating stream operators, usable on batch tables for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.config import StreamConfig

CFG = StreamConfig()


def market_key() -> Column:
    return F.concat_ws(":", "platform", "external_id")


def latest_markets(updates: DataFrame) -> DataFrame:
    """Latest snapshot, number of updates and last time per market."""
    order = F.struct("timestamp", "message_id")
    return updates.groupBy(market_key().alias("market_key")).agg(
        F.max_by("current_market", order).alias("current_market"), F.max_by("new_values.price", order).alias("price"),
        F.count(F.lit(1)).alias("updates"), F.max("timestamp").alias("last_update"))


def significant_changes(updates: DataFrame, cfg: StreamConfig = CFG) -> DataFrame:
    """Price updates that moved by more than the relative limit."""
    old, new = F.col("old_values.price"), F.col("new_values.price")
    change = F.round(F.abs(new - old) / old, 9)
    return (updates.where((F.col("update_type") == "price_change") & (old > 0))
            .withColumn("relative_change", change).where(F.col("relative_change") > cfg.price_change)
            .select("message_id", market_key().alias("market_key"), old.alias("old_price"),
                    new.alias("new_price"), "relative_change"))


def market_summary(latest: DataFrame, now: Column) -> DataFrame:
    recent = F.col("last_update") > now - F.expr("INTERVAL 1 HOUR")
    platform = F.split_part("market_key", F.lit(":"), F.lit(1))
    return latest.agg(
        F.count(F.lit(1)).alias("total_markets"), F.sum("updates").alias("total_updates"),
        F.avg("updates").alias("avg_updates_per_market"), F.count_if(recent).alias("recent_updates_last_hour"),
        F.array_join(F.sort_array(F.collect_set(platform)), ",").alias("platforms"))


def updates_per_window(updates: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Updates and distinct markets per tumbling window and platform."""
    rows = updates if watermark is None else updates.withWatermark("timestamp", watermark)
    distinct = F.approx_count_distinct if watermark else F.countDistinct
    return rows.groupBy(F.window("timestamp", width), "platform").agg(
        F.count(F.lit(1)).alias("updates"), distinct("external_id").alias("markets")).select(
        F.col("window.start").alias("window_start"), "platform", "updates", "markets")


def high_profit(opportunities: DataFrame, cfg: StreamConfig = CFG) -> DataFrame:
    """Alerts for detected opportunities: high above one threshold, critical above another."""
    share = F.col("expected_profit_percentage")
    critical = share >= cfg.critical_profit
    percent = F.format_string("%.1f%%", share * 100)
    pair = F.concat_ws(" vs ", "market1_title", "market2_title")
    return opportunities.where((F.col("action") == "detected") & (share >= cfg.high_profit)).select(
        "opportunity_id", "message_id", "timestamp", share.alias("profit_percentage"),
        F.when(critical, "critical_arbitrage_opportunity").otherwise("high_profit_opportunity").alias("alert_type"),
        F.when(critical, "critical").otherwise("high").alias("severity"),
        F.when(critical, F.concat(F.lit("Critical Arbitrage: "), percent, F.lit(" Profit")))
        .otherwise(F.concat(F.lit("High Profit Arbitrage Detected: "), percent)).alias("title"), pair.alias("market_pair"))


def stage_performance(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("stage").agg(
        F.count(F.lit(1)).alias("executions"), F.avg("processing_time_seconds").alias("avg_seconds"),
        F.sum("error_count").alias("total_errors"))


def performance_alerts(metrics: DataFrame, cfg: StreamConfig = CFG) -> DataFrame:
    slow = F.col("processing_time_seconds") > cfg.slow_seconds
    poor = F.col("success_rate") < cfg.low_success
    return metrics.where(slow | poor).select("message_id", "stage", slow.alias("is_slow"), poor.alias("is_poor"))


def recent_executions(metrics: DataFrame, now: Column) -> DataFrame:
    last = metrics.groupBy("execution_id").agg(F.max("timestamp").alias("last"))
    return last.agg(F.count(F.lit(1)).alias("total_executions"), F.count_if(
        F.col("last") > now - F.expr("INTERVAL 1 HOUR")).alias("recent_executions"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def latest_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.orderBy(F.desc("timestamp"), F.desc("message_id")).limit(n)


def alerts_per_window(alerts: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    rows = alerts if watermark is None else alerts.withWatermark("timestamp", watermark)
    return rows.groupBy(F.window("timestamp", width), "severity").agg(F.count(F.lit(1)).alias("alerts")).select(
        F.col("window.start").alias("window_start"), "severity", "alerts")


def active_opportunities(opportunities: DataFrame) -> DataFrame:
    """Open opportunities after replaying all actions in order.

    One is open when its last detection is later than its last end; what it shows is the newest
    detection or update since then. Three maxima per key, so no per-key list is built.
    """
    order = F.struct("timestamp", "message_id")
    detected, ended = F.col("action") == "detected", F.col("action").isin("expired", "executed")
    visible = F.col("action").isin("detected", "updated")
    state = F.struct("action", "expected_profit_usd", "expected_profit_percentage", "risk_level", "timestamp")
    keyed = opportunities.groupBy("opportunity_id").agg(
        F.max(F.when(detected, order)).alias("_in"), F.max(F.when(ended, order)).alias("_out"),
        F.max_by(state, F.when(visible, order)).alias("_state"), F.max(F.when(visible, order)).alias("_last"))
    is_open = F.col("_in").isNotNull() & (F.col("_out").isNull() | (F.col("_in") > F.col("_out")))
    return keyed.where(is_open).select("opportunity_id", "_state.*")


def change_messages(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Update rows from two snapshots: new, price_change, status_change, volume_change."""
    old = before.select(*keys, F.col("yes_price").alias("old_price"), F.col("volume").alias("old_volume"),
                        F.col("status").alias("old_status"), F.lit(True).alias("_known"))
    joined = after.join(old, keys, "left")
    moved = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    kind = (F.when(F.col("_known").isNull(), "new").when(moved("yes_price", "old_price"), "price_change")
            .when(moved("status", "old_status"), "status_change")
            .when(moved("volume", "old_volume"), "volume_change"))
    return joined.withColumn("update_type", kind).where(F.col("update_type").isNotNull()).select(
        *keys, "update_type", "old_price", F.col("yes_price").alias("new_price"), "old_volume",
        F.col("volume").alias("new_volume"), "old_status", F.col("status").alias("new_status"))


def rolling_volatility(history: DataFrame, width: str = "24 hours", step: str = "1 hour",
                       watermark: str | None = None) -> DataFrame:
    """Population deviation of price per series and sliding window.

    A row is in many windows, so a batch is dealt by series and hour first: otherwise a task that reads a whole file holds all windows of it.
    """
    rows = history if watermark is None else history.withWatermark("timestamp", watermark)
    if not history.isStreaming:
        parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, "market_id", F.date_trunc("hour", "timestamp"))
    return rows.groupBy(F.window("timestamp", width, step), "market_id").agg(
        F.count(F.lit(1)).alias("points"), F.stddev_pop("price").alias("volatility"),
        F.avg("volume").alias("avg_volume")).select(
        F.col("window.start").alias("window_start"), "market_id", "points", "volatility", "avg_volume")


def volume_spikes(history: DataFrame, width: str = "1 day", sigmas: float = 2.0, back: int = 5) -> DataFrame:
    """Windows whose volume exceeds mean + k deviations of the windows before them."""
    per_window = history.groupBy("market_id", F.window("timestamp", width).alias("w")).agg(
        F.sum("volume").alias("volume")).select("market_id", F.col("w.start").alias("window_start"), "volume")
    before = Window.partitionBy("market_id").orderBy("window_start").rowsBetween(-back, -1)
    limit = F.avg("volume").over(before) + F.stddev_pop("volume").over(before) * sigmas
    return (per_window.withColumn("known", F.count("volume").over(before)).withColumn("spike_limit", limit)
            .where((F.col("known") >= 2) & (F.col("volume") > F.round("spike_limit", 6))))


def window_correlation(history: DataFrame, left: str, right: str, width: str = "1 hour") -> DataFrame:
    """Correlation of two outcomes' mean prices per market over shared windows; null where either mean never moves.

    Written out, because the built-in one fails on a group without variance, short groups that are dropped below included.
    """
    means = history.where(F.col("outcome").isin(left, right)).groupBy(
        "market_id", F.window("timestamp", width).alias("w")).agg(
        F.avg(F.when(F.col("outcome") == left, F.col("price"))).alias("a"),
        F.avg(F.when(F.col("outcome") == right, F.col("price"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return means.groupBy("market_id").agg(F.count(F.lit(1)).alias("windows"), F.try_divide(
        F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("correlation")).where(
        F.col("windows") >= 3)
