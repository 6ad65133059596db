"""Registered queries: price history, enrichment and message streams (as batch twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.operators import enrich
from crossmarket.plans.oracle_views import hits
from crossmarket.plans.registry import query
from crossmarket.functions import vocab
from crossmarket.sources import derived
from crossmarket.streaming import decode, jobs, metrics

STATS = """SELECT market_id, outcome, count(*) AS points, avg(price) FILTER (rn <= 7) AS recent, max(price) FILTER (rn = 1) AS last,
    max(price) FILTER (rn = 3) AS third, arg_max(price, rn) AS first, max(volume) FILTER (rn = 1) AS last_v,
    arg_max(volume, rn) FILTER (rn <= 5) AS first_v, stddev_pop(price) AS sp, stddev_pop(volume) AS sv,
    stddev_pop(price) FILTER (rn <= 5) AS s5, min(price) AS lo, max(price) AS hi
    FROM (SELECT *, row_number() OVER (PARTITION BY market_id, outcome ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM history)
    GROUP BY 1, 2"""
V = {"stats": STATS}


def stats(spark: SparkSession, root: str) -> DataFrame:
    return enrich.history_stats(derived.price_history(spark, root))


@query("f3_historical_context", """
    SELECT market_id, outcome, recent AS avg_recent_price, (last - recent) / recent * 100 AS price_change_percentage,
           CASE WHEN last_v > first_v THEN 'increasing' ELSE 'decreasing' END AS volume_trend FROM stats WHERE points >= 5""",
       r="avg_recent_price price_change_percentage", views=V)
def _(spark, root):
    return enrich.historical_context(stats(spark, root)).select(
        "market_id", "outcome", "avg_recent_price", "price_change_percentage", "volume_trend")


@query("f5_volatility", """
    SELECT market_id, outcome, sp AS price_volatility, sv AS volume_volatility, least(0.95, sp * 10) AS volatility_percentile,
           CASE WHEN round(s5 - sp, 9) > 0 THEN 'increasing' ELSE 'decreasing' END AS volatility_trend,
           least(1.0, (sp + sv) / 2) AS risk_score FROM stats WHERE points >= 5""",
       r="price_volatility volume_volatility volatility_percentile risk_score", views=V)
def _(spark, root):
    return enrich.volatility(stats(spark, root)).select("market_id", "outcome", "price_volatility", "volume_volatility",
                                                        "volatility_percentile", "volatility_trend", "risk_score")


@query("f6_trend", """
    SELECT market_id, outcome, s AS price_slope, CASE WHEN s > 0.01 THEN 'bullish' WHEN s < -0.01 THEN 'bearish' ELSE 'sideways' END AS price_trend,
           CASE WHEN abs(s) > 0.01 THEN least(1.0, abs(s) * 10) ELSE 0.3 END AS trend_strength,
           CASE WHEN points >= 5 THEN greatest(-1.0, least(1.0, ((last - third) / 2 - s) / (abs(s) + 0.01))) ELSE 0.0 END AS momentum_score,
           lo AS support_level, hi AS resistance_level, points * 24 AS trend_duration_hours
    FROM (SELECT *, round((last - first) / points, 9) AS s FROM stats WHERE points >= 3)""",
       r="price_slope trend_strength momentum_score", views=V)
def _(spark, root):
    return enrich.trend(stats(spark, root)).select("market_id", "outcome", "price_slope", "price_trend", "trend_strength",
                                                   "momentum_score", "support_level", "resistance_level", "trend_duration_hours")


CHANGES = """SELECT * FROM (SELECT *, lag(price) OVER (PARTITION BY market_id, outcome ORDER BY "timestamp", event_id) AS previous_price FROM history)
    WHERE previous_price IS NULL OR price <> previous_price"""


@query("f7_price_changes", "SELECT event_id, price, previous_price FROM changes", views={"changes": CHANGES})
def _(spark, root):
    return enrich.price_changes(derived.price_history(spark, root)).select("event_id", "price", "previous_price")


GOOD, BAD = (hits("lower(title || ' ' || description)", w) for w in (vocab.POSITIVE_WORDS, vocab.NEGATIVE_WORDS))


@query("e7_enrichment_summary", f"""
    SELECT count(*) AS total_enriched_markets, count(*) FILTER (s > 0.2) AS sentiment_positive, count(*) FILTER (s < -0.2) AS sentiment_negative,
           count(*) FILTER (s BETWEEN -0.2 AND 0.2) AS sentiment_neutral, count(v) AS with_volatility, count(t) AS with_trends,
           coalesce(avg(v), 0) AS average_volatility_score FROM (
      SELECT CASE WHEN g + b = 0 THEN 0.0 ELSE (g - b)::DOUBLE / (g + b) END AS s,
             CASE WHEN v IS NOT NULL THEN least(1.0, v) END AS v, t FROM (
        SELECT n, {GOOD} AS g, {BAD} AS b FROM markets) m
      LEFT JOIN (SELECT market_id, CASE WHEN count(*) >= 5 THEN (stddev_pop(price) + stddev_pop(volume)) / 2 END AS v,
                        CASE WHEN count(*) >= 3 THEN 1 END AS t FROM history GROUP BY 1) h ON h.market_id = CAST(m.n AS VARCHAR))""",
       r="average_volatility_score")
def _(spark, root):
    """Sentiment, context, volatility and trend joined onto the listings, summarized."""
    enriched = enrich.enrich(derived.markets(spark, root), derived.price_history(spark, root), "external_id")
    return enrich.enrichment_summary(enriched).select(
        "total_enriched_markets", "sentiment_positive", "sentiment_negative", "sentiment_neutral", "with_volatility",
        "with_trends", "average_volatility_score")


@query("k27_enriched_markets", f"""
    SELECT n, CASE WHEN g + b = 0 THEN 0.0::DOUBLE ELSE (g - b)::DOUBLE / (g + b) END AS sentiment_score, lo AS support_level, hi AS resistance_level
    FROM (SELECT n, {GOOD} AS g, {BAD} AS b FROM markets) m
    LEFT JOIN (SELECT market_id, min(price) AS lo, max(price) AS hi FROM history GROUP BY 1 HAVING count(*) >= 3) h
      ON h.market_id = CAST(m.n AS VARCHAR)""", r="sentiment_score")
def _(spark, root):
    enriched = enrich.enrich(derived.markets(spark, root), derived.price_history(spark, root), "external_id")
    return enriched.select("n", F.col("sentiment.score").alias("sentiment_score"), "trend_analysis.support_level",
                           "trend_analysis.resistance_level")


# --- message streams -------------------------------------------------------------------------

def decoded(spark: SparkSession, root: str) -> DataFrame:
    return decode.decode(derived.stream_messages(spark, root))


@query("l1_route_counts", """
    SELECT CASE kind WHEN 'user_joined' THEN 'unknown' ELSE kind END AS route, count(*) AS messages FROM messages GROUP BY 1""")
def _(spark, root):
    return decode.route_counts(decoded(spark, root))


ACTIONS = """SELECT *, 'opp-' || (user_id % 200) AS opportunity_id, ['detected', 'updated', 'expired', 'executed'][CAST(event_id % 7 % 4 + 1 AS INT)] AS action,
    (event_id % 30) / 100.0::DOUBLE AS share, 'm' || event_id AS message_id FROM messages WHERE kind = 'arbitrage_opportunity'"""


@query("l2_open_opportunities", """
    SELECT o.opportunity_id, arg_max(a.share, (a.ts, a.message_id)) AS expected_profit_percentage, max(a.ts) AS "timestamp"
    FROM (SELECT opportunity_id, max((ts, message_id)) FILTER (action = 'detected') AS i,
                 max((ts, message_id)) FILTER (action IN ('expired', 'executed')) AS e FROM actions GROUP BY 1) o
    JOIN actions a USING (opportunity_id) WHERE o.i IS NOT NULL AND (o.e IS NULL OR o.i > o.e) AND a.action IN ('detected', 'updated')
    GROUP BY 1""", views={"actions": ACTIONS})
def _(spark, root):
    rows = decode.body(decoded(spark, root), "arbitrage_opportunity")
    return metrics.active_opportunities(rows).select("opportunity_id", "expected_profit_percentage", "timestamp")


@query("l3_high_profit_alerts", """
    SELECT message_id, CASE WHEN share >= 0.2 THEN 'critical' ELSE 'high' END AS severity, share AS profit_percentage,
           CASE WHEN share >= 0.2 THEN printf('Critical Arbitrage: %.1f%% Profit', share * 100)
                ELSE printf('High Profit Arbitrage Detected: %.1f%%', share * 100) END AS title
    FROM actions WHERE action = 'detected' AND share >= 0.1""", views={"actions": ACTIONS})
def _(spark, root):
    return metrics.high_profit(decode.body(decoded(spark, root), "arbitrage_opportunity")).select(
        "message_id", "severity", "profit_percentage", "title")


UPDATES = """SELECT *, CASE WHEN user_id % 2 = 0 THEN 'kalshi:' ELSE 'polymarket:' END || user_id AS market_key, 'm' || event_id AS message_id,
    ['new', 'price_change', 'volume_change', 'status_change'][CAST(event_id % 4 + 1 AS INT)] AS update_type, ((event_id % 97) + 1) / 100.0::DOUBLE AS old
    FROM messages WHERE kind = 'market_update'"""
U = {"updates": UPDATES}


def updates(spark: SparkSession, root: str) -> DataFrame:
    return decode.body(decoded(spark, root), "market_update")


@query("l4_latest_markets", """
    SELECT market_key, arg_max(price, (ts, message_id)) AS price, count(*) AS updates, max(ts) AS last_update FROM updates GROUP BY 1""", views=U)
def _(spark, root):
    return metrics.latest_markets(updates(spark, root)).select("market_key", "price", "updates", "last_update")


@query("l5_significant_changes", """
    SELECT message_id, market_key, old AS old_price, price AS new_price, round(abs(price - old) / old, 9) AS relative_change FROM updates
    WHERE update_type = 'price_change' AND round(abs(price - old) / old, 9) > 0.05""", r="relative_change", views=U)
def _(spark, root):
    return metrics.significant_changes(updates(spark, root))


NOW = "2024-01-30 23:00:00"


@query("l6_market_summary", f"""
    SELECT count(*) AS total_markets, CAST(sum(c) AS BIGINT) AS total_updates, avg(c) AS avg_updates_per_market,
           count(*) FILTER (t > TIMESTAMP '{NOW}' - to_hours(1)) AS recent_updates_last_hour, 'kalshi,polymarket' AS platforms
    FROM (SELECT market_key, count(*) AS c, max(ts) AS t FROM updates GROUP BY 1)""", r="avg_updates_per_market", views=U)
def _(spark, root):
    return metrics.market_summary(metrics.latest_markets(updates(spark, root)), F.lit(NOW).cast("timestamp"))


@query("l6_updates_per_window", """
    SELECT date_trunc('hour', ts) AS window_start, split_part(market_key, ':', 1) AS platform, count(*) AS updates,
           count(DISTINCT user_id) AS markets FROM updates GROUP BY 1, 2""", views=U)
def _(spark, root):
    return metrics.updates_per_window(updates(spark, root))


RUNS = """SELECT *, ['extract', 'normalize', 'bucket', 'filter', 'evaluate'][CAST(event_id % 5 + 1 AS INT)] AS stage, 'm' || event_id AS message_id,
    event_id % 4 AS errors, (80 + event_id % 21) / 100.0::DOUBLE AS success FROM messages WHERE kind = 'pipeline_metrics'"""


@query("l7_stage_performance", """
    SELECT stage, count(*) AS executions, avg(value) AS avg_seconds, CAST(sum(errors) AS BIGINT) AS total_errors FROM runs GROUP BY 1""",
       r="avg_seconds", views={"runs": RUNS})
def _(spark, root):
    return metrics.stage_performance(decode.body(decoded(spark, root), "pipeline_metrics"))


@query("l7_performance_alerts", """
    SELECT message_id, stage, value > 300 AS is_slow, success < 0.9 AS is_poor FROM runs WHERE value > 300 OR success < 0.9""", views={"runs": RUNS})
def _(spark, root):
    return metrics.performance_alerts(decode.body(decoded(spark, root), "pipeline_metrics"))


@query("l7_recent_executions", f"""
    SELECT count(*) AS total_executions, count(*) FILTER (t > TIMESTAMP '{NOW}' - to_hours(1)) AS recent_executions
    FROM (SELECT user_id % 50 AS e, max(ts) AS t FROM runs GROUP BY 1)""", views={"runs": RUNS})
def _(spark, root):
    return metrics.recent_executions(decode.body(decoded(spark, root), "pipeline_metrics"), F.lit(NOW).cast("timestamp"))


ALERTS = """SELECT *, ['high_profit_opportunity', 'pipeline_failure', 'data_quality_issue'][CAST(event_id % 3 + 1 AS INT)] AS alert_type,
    ['low', 'medium', 'high', 'critical'][CAST(event_id % 4 + 1 AS INT)] AS severity, 'm' || event_id AS message_id FROM messages WHERE kind = 'alert'"""
A = {"alerts_in": ALERTS}


@query("l8_alert_counts", "SELECT alert_type, severity, count(*) AS alerts FROM alerts_in GROUP BY 1, 2", views=A)
def _(spark, root):
    return metrics.alert_counts(decode.body(decoded(spark, root), "alert"))


@query("l8_latest_alerts", "SELECT message_id, alert_type, severity FROM alerts_in ORDER BY ts DESC, message_id DESC LIMIT 10", views=A)
def _(spark, root):
    return metrics.latest_alerts(decode.body(decoded(spark, root), "alert")).select("message_id", "alert_type", "severity")


@query("l8_alerts_per_window", "SELECT date_trunc('hour', ts) AS window_start, severity, count(*) AS alerts FROM alerts_in GROUP BY 1, 2", views=A)
def _(spark, root):
    return metrics.alerts_per_window(decode.body(decoded(spark, root), "alert"))


@query("l9_change_messages", """
    SELECT id, CASE WHEN category = 'Sports' THEN 'new' WHEN n % 4 = 0 AND yes_price <> no_price THEN 'price_change'
                    WHEN is_active THEN 'status_change' WHEN n % 3 = 0 THEN 'volume_change' END AS update_type
    FROM markets WHERE category = 'Sports' OR (n % 4 = 0 AND yes_price <> no_price) OR is_active OR n % 3 = 0""")
def _(spark, root):
    m = derived.markets(spark, root)
    n = F.col("n")
    before = m.where("category <> 'Sports'").select(
        "id", F.when(n % 4 == 0, F.col("no_price")).otherwise(F.col("yes_price")).alias("yes_price"),
        F.when(n % 3 == 0, F.col("volume") + 1).otherwise(F.col("volume")).alias("volume"), F.lit("closed").alias("status"))
    return metrics.change_messages(before, m, ["id"]).select("id", "update_type")


@query("l10_keyed_messages", """
    SELECT message_id, opportunity_id AS key, 'arbitrage-opportunities' AS topic, action FROM actions""", views={"actions": ACTIONS})
def _(spark, root):
    rows = decode.body(decoded(spark, root), "arbitrage_opportunity")
    out = jobs.keyed_messages(rows, "arbitrage_opportunity")
    part = lambda p: F.get_json_object("value", f"$.{p}").alias(p)
    return out.select(part("message_id"), "key", "topic", part("action"))


@query("a15_keyed_topics", """
    SELECT CASE kind WHEN 'market_update' THEN 'market-updates' WHEN 'arbitrage_opportunity' THEN 'arbitrage-opportunities'
             WHEN 'pipeline_metrics' THEN 'pipeline-metrics' ELSE 'alerts' END AS topic, count(*) AS messages
    FROM messages WHERE kind NOT IN ('malformed', 'user_joined') GROUP BY 1""")
def _(spark, root):
    rows = decoded(spark, root)
    parts = [jobs.keyed_messages(decode.body(rows, kind), kind) for kind in decode.BODIES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


@query("l12_rolling_volatility", """
    SELECT w AS window_start, market_id, count(*) AS points, stddev_pop(price) AS volatility, avg(volume) AS avg_volume
    FROM (SELECT *, unnest(generate_series(date_trunc('hour', "timestamp") - to_hours(23), date_trunc('hour', "timestamp"), to_hours(1))) AS w FROM history)
    GROUP BY 1, 2""", r="volatility avg_volume")
def _(spark, root):
    return metrics.rolling_volatility(derived.price_history(spark, root))


DAILY = """SELECT market_id, date_trunc('day', "timestamp")::TIMESTAMP AS window_start, sum(volume) AS volume FROM history GROUP BY 1, 2"""


@query("l12_volume_spikes", """
    SELECT market_id, window_start, volume FROM (SELECT *, count(*) OVER b AS known, avg(volume) OVER b + 2 * stddev_pop(volume) OVER b AS cap
      FROM daily WINDOW b AS (PARTITION BY market_id ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    WHERE known >= 2 AND volume > round(cap, 6)""", r="volume", views={"daily": DAILY})
def _(spark, root):
    return metrics.volume_spikes(derived.price_history(spark, root)).select("market_id", "window_start", "volume")


@query("l12_window_correlation", """
    SELECT market_id, count(*) AS windows, corr(a, b) AS correlation FROM (
      SELECT market_id, date_trunc('day', "timestamp") AS w, avg(price) FILTER (outcome = 'view') AS a, avg(price) FILTER (outcome = 'click') AS b
      FROM history WHERE outcome IN ('view', 'click') GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
       r="correlation")
def _(spark, root):
    return metrics.window_correlation(derived.price_history(spark, root), "view", "click", "1 day")


@query("l13_price_history_stream", "SELECT event_id, price FROM changes", views={"changes": CHANGES})
def _(spark, root):
    """The batch twin of the stateful price-change stream."""
    return enrich.price_changes(derived.price_history(spark, root)).select("event_id", "price")
