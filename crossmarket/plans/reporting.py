"""Registered queries: filters, quality checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.functions import outcomes, vocab
from crossmarket.operators import browse, groups, normalize, quality, reports, tables
from crossmarket.operators.browse import Browse
from crossmarket.plans import sqltext as sq
from crossmarket.plans.evaluations import marked, MARKED, platforms, with_outcomes
from crossmarket.plans.listings import AS_OF_ISO, kalshi_envelopes, mixed_envelopes, MIXED
from crossmarket.plans.oracle_views import T, quoted
from crossmarket.plans.registry import query
from crossmarket.sources import derived, landing
from crossmarket.sources.derived import AS_OF

LATER = f"close_time > '{AS_OF_ISO}'"


# --- filters ---------------------------------------------------------------------------------

@query("c1_open_listings", f"""
    SELECT n FROM raw_kalshi WHERE {LATER} AND status IN ('active', 'initialized')
      AND (coalesce(ticker, '') <> '' OR coalesce(id, '') <> '') AND coalesce(title, '') <> ''""")
def _(spark, root):
    return browse.open_listings(derived.raw_kalshi(spark, root), AS_OF_ISO).select("n")


SOME = lambda c, v=0: f"coalesce({c}, 0) > {v}"


@query("c2_tradable_listings", f"""
    SELECT n, true AS with_quotes FROM raw_kalshi WHERE status = 'active' AND can_close_early AND {LATER}
      AND ({SOME('volume')} OR {SOME('liquidity', 1000)} OR {SOME('open_interest')} OR ({SOME('yes_bid')} AND {SOME('yes_ask')}))
    UNION ALL SELECT n, false FROM raw_kalshi WHERE status = 'active' AND can_close_early AND {LATER}
      AND ({SOME('volume')} OR {SOME('liquidity', 1000)} OR {SOME('open_interest')})""")
def _(spark, root):
    raw = derived.raw_kalshi(spark, root)
    pick = lambda q: raw.where(browse.tradability(AS_OF_ISO, q)).select("n", F.lit(q).alias("with_quotes"))
    return pick(True).unionByName(pick(False))


@query("c3_priced_activity", f"""
    SELECT n FROM raw_kalshi WHERE status IN ('active', 'initialized') AND can_close_early AND {LATER}
      AND ({SOME('liquidity')} OR {SOME('volume')} OR {SOME('open_interest')})
      AND ({SOME('yes_bid')} OR {SOME('yes_ask')} OR {SOME('last_price')})""")
def _(spark, root):
    return derived.raw_kalshi(spark, root).where(browse.activity(AS_OF_ISO)).select("n")


TRULY = "coalesce((round(volume) > 0 OR liquidity > 1000 OR open_interest > 0) AND status = 'active', false)"
KEY = "coalesce(nullif(ticker, ''), id)"


@query("c4_truly_active", f"SELECT {KEY} AS external_id FROM raw_kalshi WHERE {KEY} IS NOT NULL AND {TRULY}")
def _(spark, root):
    return kalshi_envelopes(spark, root).where(browse.truly_active()).select("external_id")


BINARY = """coalesce(len(outcome_names) >= 2 AND (len(outcome_names) = 2
    OR len(list_filter(outcome_names, lambda o: lower(o) IN ('yes', 'true', '1'))) > 0), false)"""
PRICED = "(lastTradePrice IS NOT NULL OR (bestBid IS NOT NULL AND bestAsk IS NOT NULL))"


@query("c5_binary_outcomes_and_c6_priced", f"SELECT n, {BINARY} AS is_binary, {PRICED} AS is_priced FROM raw_polymarket")
def _(spark, root):
    return derived.raw_polymarket(spark, root).select("n", outcomes.is_binary(F.col("outcomes")).alias("is_binary"),
                                                      browse.priced().alias("is_priced"))


@query("c7_valid_binary_listings", f"""
    SELECT n FROM raw_polymarket WHERE id IS NOT NULL AND question IS NOT NULL AND {BINARY} AND {PRICED}""")
def _(spark, root):
    return browse.valid_binary(derived.raw_polymarket(spark, root)).select("n")


@query("c8_small_outcome_sets", """
    SELECT n, len(list_filter(coalesce(outcome_names, []), lambda o: contains(lower(o), 'yes') OR contains(lower(o), 'no'))) > 0
           OR coalesce(len(outcome_names), 0) <= 4 AS kept FROM raw_polymarket""")
def _(spark, root):
    return derived.raw_polymarket(spark, root).select("n", outcomes.is_yes_no_or_small(F.col("outcomes")).alias("kept"))


@query("c9_quality_gate", """
    SELECT n, is_active AS should_process, is_active AS has_end_date FROM markets""")
def _(spark, root):
    return browse.quality_flags(with_outcomes(derived.markets(spark, root)), AS_OF).select("n", "should_process", "has_end_date")


@query("c10_browse", """
    SELECT id, volume FROM markets WHERE status = 'active' AND category = 'Crypto' AND volume >= 1000 AND liquidity <= 20000
      AND close_time <= TIMESTAMP '2001-11-15' ORDER BY open_time DESC, id LIMIT 50""")
def _(spark, root):
    ask = Browse(category="Crypto", min_volume=1000.0, max_liquidity=20000.0, end_before="2001-11-15")
    return browse.newest(derived.markets(spark, root), ask).select("id", "volume")


@query("c11_title_search", """
    SELECT id, r AS match_rank FROM (SELECT id, list_contains(w, 'bitcoin')::INT + list_contains(w, 'blue')::INT
      + list_contains(w, 'ring')::INT AS r FROM (SELECT id, string_split(lower(title), ' ') AS w FROM markets WHERE status = 'active'))
    WHERE r > 0 ORDER BY r DESC, id LIMIT 50""")
def _(spark, root):
    return browse.search(derived.markets(spark, root), "Bitcoin blue ring").select("id", "match_rank")


@query("c12_next_page", """
    SELECT id FROM markets WHERE status = 'active' AND (open_time < TIMESTAMP '1995-06-01' OR (open_time = TIMESTAMP '1995-06-01'
      AND id > 'kalshi-5')) ORDER BY open_time DESC, id LIMIT 50""")
def _(spark, root):
    return browse.page_after(derived.markets(spark, root), Browse(), ("1995-06-01", "kalshi-5")).select("id")


@query("c13_active_by_platform", """
    SELECT id FROM markets WHERE status = 'active' AND platform = 'kalshi' AND category = 'Sports' ORDER BY open_time DESC, id LIMIT 100""")
def _(spark, root):
    return browse.newest(derived.markets(spark, root), Browse(platform="kalshi", category="Sports", count=100)).select("id")


@query("c14_platform_markets", "SELECT id FROM markets WHERE platform = 'polymarket' ORDER BY open_time DESC, id LIMIT 100")
def _(spark, root):
    return derived.venue(derived.markets(spark, root), "polymarket").orderBy(F.desc("open_time"), "id").limit(100).select("id")


@query("c25_price_volume_window", "SELECT id FROM markets WHERE volume > 50 AND yes_price BETWEEN 0.05 AND 0.95")
def _(spark, root):
    return derived.markets(spark, root).where((F.col("volume") > 50) & F.col("yes_price").between(0.05, 0.95)).select("id")


@query("c26_high_value_listings", "SELECT id, volume FROM markets WHERE volume > 100 ORDER BY volume DESC, id LIMIT 10")
def _(spark, root):
    return browse.high_value(derived.markets(spark, root)).select("id", "volume")


@query("d16_platform_names", """
    SELECT id, CASE platform WHEN 'kalshi' THEN 'Kalshi' ELSE 'Unknown' END AS platform_display_name FROM markets""")
def _(spark, root):
    known = platforms(spark).where(F.col("name") != "polymarket")
    return browse.with_platform_names(derived.markets(spark, root), known).select("id", "platform_display_name")


@query("d20_platform_status", """
    SELECT p.name, count(l.run_id) AS recent, max(l.started_at) AS last_sync
    FROM (VALUES ('polymarket'), ('kalshi'), ('predictit'), ('manifold')) p(name) LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY platform ORDER BY started_at DESC, run_id DESC) AS rn
      FROM (SELECT * FROM run_logs ORDER BY started_at DESC, run_id DESC LIMIT 100)) l ON l.platform = p.name AND rn <= 5
    GROUP BY 1""")
def _(spark, root):
    logs = derived.run_logs(spark, root).select("platform", "status", F.col("run_id").alias("log_id"), F.col("started_at").alias("timestamp"))
    df = groups.platform_status(platforms(spark), logs)
    return df.select("name", F.coalesce(F.size("recent_logs"), F.lit(0)).alias("recent"), "last_sync")


# --- quality checks --------------------------------------------------------------------------

RAW = """SELECT * REPLACE (CASE WHEN n % 13 = 0 THEN '' ELSE title END AS title, CASE WHEN n % 19 = 0 THEN 0.5 ELSE yes_price END AS yes_price,
    CASE WHEN n % 19 = 0 THEN 0.5 WHEN n % 23 = 0 THEN 0.0 ELSE no_price END AS no_price,
    CASE WHEN n % 6 = 0 THEN 0.0 ELSE liquidity END AS liquidity), CASE WHEN n % 29 = 0 THEN NULL ELSE close_time END AS end_date
    FROM unified"""


def flawed(spark: SparkSession, root: str) -> DataFrame:
    """Listings with missing titles, default and inconsistent prices, gaps."""
    n = F.col("n")
    df = derived.unified(spark, root)
    return df.withColumns({
        "title": F.when(n % 13 == 0, "").otherwise(F.col("title")),
        "yes_price": F.when(n % 19 == 0, 0.5).otherwise(F.col("yes_price")),
        "no_price": F.when(n % 19 == 0, 0.5).when(n % 23 == 0, 0.0).otherwise(F.col("no_price")),
        "liquidity": F.when(n % 6 == 0, 0.0).otherwise(F.col("liquidity")),
        "end_date": F.when(n % 29 == 0, None).otherwise(F.col("close_time"))})


PER = lambda pair: f"CASE platform WHEN 'kalshi' THEN {pair[0]} ELSE {pair[1]} END"
PCT = lambda x, t="total": f"round(round({x} / {t} * 100, 9), 1)"


def long_sql(checks: list[tuple[str, str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, platform, ({v})::DOUBLE AS value, {s} AS status FROM {source}"
                              for m, v, s in checks)


FILLED = {"Title": "title <> ''", "Yes Price": "yes_price > 0", "No Price": "no_price > 0", "Volume": "volume >= 0",
          "Liquidity": "liquidity > 0", "Category": "category <> ''", "End Date": "end_date IS NOT NULL"}
ODD = {"Short Titles (<10 chars)": "length(title) < 10", "Long Titles (>200 chars)": "length(title) > 200",
       "Default Prices (0.5/0.5)": "yes_price = 0.5 AND no_price = 0.5",
       "Invalid Price Sums": "round(yes_price + no_price, 9) <> 1.0", "Uncategorized Markets": "category = 'other'"}
SUMS = "SELECT platform, count(*) AS total, " + ", ".join(
    f'count(*) FILTER ({c}) AS "{n}"' for n, c in {**FILLED, **ODD}.items()) + """,
    count(*) FILTER (volume > 0) AS hv, count(*) FILTER (liquidity > 0) AS hl, count(*) FILTER (category = 'other') AS other,
    avg(yes_price) AS ay, count(*) FILTER (yes_price BETWEEN 0.01 AND 0.99) AS vy FROM raw_markets GROUP BY platform"""
QV = {"raw_markets": RAW, "sums": SUMS}


def low(share: str, want: str, margin: int, names=("PASS", "WARN", "FAIL")) -> str:
    return f"CASE WHEN {share} >= {want} THEN '{names[0]}' WHEN {share} >= {want} - {margin} THEN '{names[1]}' ELSE '{names[2]}' END"


COVERAGE = long_sql([("Total Markets", "total", f"CASE WHEN total < {PER((4000, 8000))} THEN 'WARN' ELSE 'PASS' END")], "sums")
COMPLETE = long_sql([(f"{n} Completeness", PCT(f'"{n}"'), low(f'"{n}" / total * 100', PER(quality.COMPLETENESS[n]), 10))
                     for n in FILLED], "sums")
ANOMALY = long_sql([(n, PCT(f'"{n}"'), f"""CASE WHEN "{n}" / total * 100 <= {PER(quality.ANOMALIES[n])} THEN 'PASS'
    WHEN "{n}" / total * 100 <= {PER(quality.ANOMALIES[n])} * 2 THEN 'WARN' ELSE 'FAIL' END""") for n in ODD], "sums")
PRICES = long_sql([
    ("Valid Price Range", PCT("vy"), "CASE WHEN vy / total * 100 < 60 THEN 'FAIL' WHEN vy / total * 100 < 80 THEN 'WARN' ELSE 'PASS' END"),
    ("Price Diversity", "round(ay, 3)", "CASE WHEN abs(ay - 0.5) < 0.05 THEN 'WARN' ELSE 'PASS' END")], "sums")
VOLUMES = long_sql([("Volume Coverage", PCT("hv"), low("hv / total * 100", PER((15, 80)), 20)),
                    ("Liquidity Coverage", PCT("hl"), low("hl / total * 100", PER((70, 25)), 20))], "sums")
CATEGORY = long_sql([("Category Classification", PCT("other"),
                      "CASE WHEN other / total * 100 > 70 THEN 'FAIL' WHEN other / total * 100 > 50 THEN 'WARN' ELSE 'PASS' END")], "sums")
CROSS = """SELECT *, polymarket_value / kalshi_value AS ratio, CASE WHEN metric = 'Total Markets' AND (polymarket_value / kalshi_value < 1.5
      OR polymarket_value / kalshi_value > 3) THEN 'WARN' ELSE 'PASS' END AS status FROM (
    SELECT 'Total Markets' AS metric, count(*) FILTER (platform = 'kalshi')::DOUBLE AS kalshi_value,
           count(*) FILTER (platform = 'polymarket')::DOUBLE AS polymarket_value FROM raw_markets
    UNION ALL SELECT 'Avg Volume', avg(volume) FILTER (platform = 'kalshi'), avg(volume) FILTER (platform = 'polymarket') FROM raw_markets
    UNION ALL SELECT 'Avg Liquidity', avg(liquidity) FILTER (platform = 'kalshi'), avg(liquidity) FILTER (platform = 'polymarket') FROM raw_markets)"""
ALL = f"""{COVERAGE} UNION ALL {COMPLETE} UNION ALL SELECT * FROM ({ANOMALY}) WHERE status <> 'PASS'
    UNION ALL SELECT * FROM ({PRICES} UNION ALL {VOLUMES} UNION ALL {CATEGORY}) WHERE status <> 'PASS'
    UNION ALL SELECT 'Market Count Ratio', 'Cross-platform', round(ratio, 2), status FROM ({CROSS}) WHERE status <> 'PASS'"""

for _name, _sql, _fn in (
        ("e16_coverage", COVERAGE, quality.coverage), ("e17_completeness", COMPLETE, quality.completeness),
        ("e18_anomalies", ANOMALY, lambda df: quality.anomalies(df, True)), ("e19_price_checks", PRICES, quality.price_checks),
        ("e20_volume_checks", VOLUMES, quality.volume_checks), ("e21_category_check", CATEGORY, quality.category_check),
        ("e22_all_checks", ALL, quality.all_checks)):
    @query(_name, _sql, views=QV)
    def _(spark, root, fn=_fn):
        return fn(flawed(spark, root))


@query("e19_price_stats", """
    SELECT platform, count(*) AS total, avg(yes_price) AS avg_yes_price, min(yes_price) AS min_yes_price, max(yes_price) AS max_yes_price,
           stddev(yes_price) AS std_yes_price, count(*) FILTER (yes_price BETWEEN 0.01 AND 0.99) AS valid_yes_prices
    FROM raw_markets GROUP BY platform""", r="avg_yes_price std_yes_price", views=QV)
def _(spark, root):
    return quality.price_stats(flawed(spark, root))


@query("e21_category_shares", """
    SELECT platform, category, n, avg_volume, round(round(n / t * 100, 9), 1) AS share_pct, rn FROM (
      SELECT *, sum(n) OVER (PARTITION BY platform) AS t, row_number() OVER (PARTITION BY platform ORDER BY n DESC, category) AS rn
      FROM (SELECT platform, category, count(*) AS n, avg(volume) AS avg_volume FROM raw_markets GROUP BY 1, 2)) WHERE rn <= 5""",
       r="avg_volume", views=QV)
def _(spark, root):
    return quality.category_shares(flawed(spark, root))


@query("e22_cross_platform", CROSS, r="kalshi_value polymarket_value ratio", views=QV)
def _(spark, root):
    return quality.cross_venue(flawed(spark, root))


@query("e23_verdict", f"""
    SELECT count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warnings,
           count(*) FILTER (status = 'FAIL') AS failed, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'NEEDS ATTENTION'
             WHEN count(*) FILTER (status = 'WARN') > 3 THEN 'REVIEW RECOMMENDED' ELSE 'GOOD' END AS overall_status FROM ({ALL})""", views=QV)
def _(spark, root):
    return quality.verdict(quality.all_checks(flawed(spark, root)))


@query("e49_quality_score", f"""
    SELECT avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) AS score, avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) < 0.8 AS alert
    FROM ({ALL})""", r="score", views=QV)
def _(spark, root):
    return quality.quality_score(quality.all_checks(flawed(spark, root)))


@query("e49_duration_alert", """
    SELECT avg(processing_time_ms) / 1000 AS avg_seconds, avg(processing_time_ms) / 1000 > 300 AS alert FROM run_logs""", r="avg_seconds")
def _(spark, root):
    return quality.duration_alert(derived.run_logs(spark, root))


# --- reports ---------------------------------------------------------------------------------

@query("e6_normalization_stats", """
    SELECT count(*) AS total_processed, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
           count(*) FILTER (ok) / count(*) AS success_rate, 1 - count(*) FILTER (ok) / count(*) AS failure_rate
    FROM (SELECT external_id NOT LIKE '%7' AND external_id NOT LIKE '%5' AS ok FROM mixed)""",
       r="success_rate failure_rate", views={"mixed": MIXED})
def _(spark, root):
    envelopes = mixed_envelopes(spark, root)
    done, _ = normalize.dispatch(envelopes, AS_OF, landing.PAYLOADS)
    return normalize.normalization_stats(envelopes, done)


@query("e9_stage_metrics", """
    SELECT stage, count(*) AS executions, avg(processing_time_ms) AS avg_processing_time, CAST(sum(input_count) AS BIGINT) AS total_input,
           CAST(sum(output_count) AS BIGINT) AS total_output, avg(output_count::DOUBLE / nullif(input_count, 0)) AS avg_efficiency
    FROM run_logs WHERE started_at >= TIMESTAMP '2001-07-25' - to_days(365) GROUP BY stage""", r="avg_processing_time avg_efficiency")
def _(spark, root):
    return reports.stage_metrics(derived.run_logs(spark, root), "2001-07-25", 365)


@query("e14_platform_validation", """
    SELECT platform, count(*) AS total, count(*) FILTER (is_active) AS active, avg(volume) AS avg_volume, avg(liquidity) AS avg_liquidity,
           count(*) FILTER (yes_price BETWEEN 0.01 AND 0.99) AS valid_prices FROM markets GROUP BY 1""", r="avg_volume avg_liquidity")
def _(spark, root):
    return reports.platform_validation(derived.markets(spark, root))


@query("e14_grand_totals", """
    SELECT count(*) AS total, count(DISTINCT platform) AS platforms, count(DISTINCT category) AS categories,
           avg(yes_price) AS avg_yes_price, avg(volume) AS avg_volume FROM markets""", r="avg_yes_price avg_volume")
def _(spark, root):
    return reports.grand_totals(derived.markets(spark, root))


@query("e15_category_distribution", "SELECT platform, category, count(*) AS markets FROM markets GROUP BY 1, 2")
def _(spark, root):
    return reports.category_distribution(derived.markets(spark, root))


@query("e30_platform_overview", """
    SELECT platform, count(*) AS market_count, avg(yes_price) AS avg_yes_price, avg(volume) AS avg_volume, min(open_time) AS earliest,
           max(open_time) AS latest FROM markets GROUP BY 1""", r="avg_yes_price avg_volume")
def _(spark, root):
    return reports.platform_overview(derived.markets(spark, root))


@query("e30_markets_per_day", """
    SELECT strftime(open_time, '%Y-%m-%d') AS market_date, count(*) AS markets_created, avg(volume) AS avg_volume FROM markets
    GROUP BY 1 ORDER BY 1 DESC LIMIT 10""", r="avg_volume")
def _(spark, root):
    return reports.markets_per_day(derived.markets(spark, root))


@query("e31_description_coverage", """
    SELECT platform, count(*) AS total, count(*) FILTER (length(description) > 16) AS rich_descriptions,
           avg(length(description)) AS avg_length FROM markets GROUP BY 1""", r="avg_length")
def _(spark, root):
    return reports.description_coverage(derived.markets(spark, root), 16)


@query("e32_load_verification", """
    SELECT platform, count(*) AS markets, count(DISTINCT category) AS categories, avg(volume) AS avg_volume,
           count(*) FILTER ((platform = 'polymarket' AND volume > 1000) OR (platform = 'kalshi' AND volume > 100)) AS high_volume_count
    FROM markets GROUP BY 1""", r="avg_volume")
def _(spark, root):
    return reports.load_verification(derived.markets(spark, root))


@query("e33_duplicate_titles", "SELECT title, count(*) AS copies FROM markets GROUP BY 1 HAVING count(*) > 1")
def _(spark, root):
    return reports.duplicates(derived.markets(spark, root), "title")


@query("e34_fetch_times", "SELECT platform, avg(processing_time_ms) AS avg_time_ms FROM run_logs WHERE api_status = 200 GROUP BY 1", r="avg_time_ms")
def _(spark, root):
    return reports.fetch_times(derived.run_logs(spark, root))


@query("e35_coverage_and_quality", """
    SELECT platform, count(*) AS total, count(DISTINCT category) AS unique_categories, max(volume) AS max_volume,
           count(*) FILTER (volume > 0) AS with_volume, count(*) FILTER (yes_price BETWEEN 0.01 AND 0.99) AS valid_prices,
           count(*) FILTER (category <> 'other') AS categorized, count(*) FILTER (length(title) > 10) AS good_titles,
           count(close_time) AS has_end_date FROM unified GROUP BY 1""")
def _(spark, root):
    return reports.coverage_and_quality(derived.unified(spark, root))


@query("e36_volume_profile", """
    SELECT status, count(*) AS total, count(*) FILTER (volume > 0) AS with_volume, min(volume) AS min_volume, max(volume) AS max_volume,
           avg(volume) AS avg_volume, avg(volume) FILTER (volume > 0) AS avg_nonzero_volume, count(*) FILTER (volume > 100) AS over_100,
           count(*) FILTER (volume > 1000) AS over_1000, avg(liquidity) AS avg_liquidity,
           avg(liquidity) FILTER (liquidity > 0) AS avg_nonzero_liquidity FROM raw_markets GROUP BY 1""",
       r="avg_volume avg_nonzero_volume avg_liquidity avg_nonzero_liquidity", views=QV)
def _(spark, root):
    return reports.volume_profile(flawed(spark, root), "status")


@query("e37_activity_funnel", f"""
    SELECT count(*) AS total_markets, count(*) FILTER (round(volume) > 0) AS with_volume, count(*) FILTER (liquidity > 1000) AS with_liquidity,
           count(*) FILTER (open_interest > 0) AS with_interest,
           count(*) FILTER (round_half(yes_bid) > 0 AND round_half(yes_ask) > round_half(yes_bid)) AS with_quotes,
           count(*) FILTER ({TRULY}) AS truly_active FROM raw_kalshi WHERE {KEY} IS NOT NULL""".replace("round_half", "round"))
def _(spark, root):
    w, x = browse.payload_whole, browse.payload_number
    c = reports.count_if
    return kalshi_envelopes(spark, root).agg(
        F.count(F.lit(1)).alias("total_markets"), c(w("volume") > 0, "with_volume"), c(x("liquidity") > 1000, "with_liquidity"),
        c(w("open_interest") > 0, "with_interest"), c((w("yes_bid") > 0) & (w("yes_ask") > w("yes_bid")), "with_quotes"),
        c(browse.truly_active(), "truly_active"))


@query("e38_proxy_consistency", """
    SELECT count(*) AS total, count(*) FILTER (abs(volume - liquidity / 1000) < 0.01) AS matches_formula,
           count(*) FILTER (volume = 0 AND liquidity = 0) AS both_zero, count(*) FILTER (volume > 0 AND liquidity = 0) AS volume_only,
           count(*) FILTER (volume = 0 AND liquidity > 0) AS liquidity_only FROM raw_markets""", views=QV)
def _(spark, root):
    return reports.proxy_consistency(flawed(spark, root))


@query("e39_event_rollup", """
    SELECT event_id AS event_ticker, count(*) AS markets_count, count(*) FILTER (is_active) AS active_markets_count,
           count(*) FILTER (volume > 100) AS high_volume_count, sum(volume) AS total_volume, max(volume) AS max_volume
    FROM markets GROUP BY 1""", r="total_volume")
def _(spark, root):
    m = derived.markets(spark, root).withColumnRenamed("event_id", "event_ticker")
    return landing.event_rollup(m, F.col("is_active"))


@query("e40_active_range", """
    SELECT count(*) AS total_markets, coalesce(min(volume), 0) AS min_volume, coalesce(max(volume), 0) AS max_volume,
           coalesce(min(liquidity), 0) AS min_liquidity, coalesce(max(liquidity), 0) AS max_liquidity FROM markets WHERE status = 'active'""")
def _(spark, root):
    return reports.active_range(derived.markets(spark, root))


@query("e41_market_stats", """
    SELECT unnest(['total_markets', 'active_markets']) AS measure, CAST(NULL AS VARCHAR) AS key,
           unnest([count(*), count(*) FILTER (is_active)])::DOUBLE AS value FROM markets
    UNION ALL SELECT unnest(['total_opportunities', 'avg_profit_margin']), NULL, unnest([count(*)::DOUBLE, coalesce(avg(profit_margin), 0)])
    FROM marked WHERE status = 'active'
    UNION ALL SELECT 'platform_count', platform, count(*)::DOUBLE FROM markets GROUP BY platform
    UNION ALL SELECT 'category_count', category, count(*)::DOUBLE FROM markets GROUP BY category""", r="value", views=MARKED)
def _(spark, root):
    return reports.market_stats(derived.markets(spark, root), marked(spark, root).where("status = 'active'"))


FIELDS = ["yes_bid", "yes_ask", "no_bid", "no_ask", "volume", "volume_24h", "liquidity", "open_interest", "last_price", "close_time"]


@query("e42_field_availability", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS present, count({c}) / count(*) * 100 AS share_pct FROM raw_kalshi" for c in FIELDS), r="share_pct")
def _(spark, root):
    return reports.field_availability(derived.raw_kalshi(spark, root), FIELDS)


REPAIRED = """SELECT platform, count(*) AS total, count(*) FILTER (yes_price BETWEEN 0.01 AND 0.99) AS valid_yes,
    count(*) FILTER (no_price BETWEEN 0.01 AND 0.99) AS valid_no, count(*) FILTER (round(abs(yes_price + no_price - 1), 9) <= 0.01) AS valid_sums,
    count(*) FILTER (category <> 'other') AS categorized, count(*) FILTER (volume > 0) AS has_volume, avg(volume) AS avg_volume
    FROM raw_markets GROUP BY 1"""


@query("e43_repair_validation", REPAIRED, r="avg_volume", views=QV)
def _(spark, root):
    return reports.repair_validation(flawed(spark, root))


@query("e46_category_summary", """
    SELECT category, count(*) AS market_count, sum(volume) AS total_volume,
           array_to_string((list(title ORDER BY volume DESC, id))[1:3], ',') AS top_markets FROM markets GROUP BY 1""", r="total_volume")
def _(spark, root):
    return reports.top_titles(derived.markets(spark, root)).select("category", "market_count", "total_volume", "top_markets")


@query("e46_created_trend", """
    SELECT time_bucket(INTERVAL 7 DAY, open_time, TIMESTAMP '1970-01-01') AS window_start, count(*) AS markets, avg(volume) AS avg_volume
    FROM markets GROUP BY 1""", r="avg_volume")
def _(spark, root):
    return reports.created_trend(derived.markets(spark, root))


@query("e48_execution_history", """
    SELECT run_id, stage, status, started_at, error_count FROM run_logs ORDER BY started_at DESC, run_id DESC LIMIT 10""")
def _(spark, root):
    return reports.execution_history(derived.run_logs(spark, root)).select("run_id", "stage", "status", "started_at", "error_count")


@query("f12_category_percentages", """
    SELECT category, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS share_pct FROM unified WHERE platform = 'polymarket' GROUP BY 1""",
       r="share_pct")
def _(spark, root):
    from pyspark.sql import Window
    counts = derived.venue(derived.unified(spark, root), "polymarket").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


@query("h1_union_of_feeds", """
    SELECT 'K' || n AS external_id, 'kalshi' AS platform, NULL AS slug FROM raw_kalshi
    UNION ALL SELECT 'P' || n, 'polymarket', slug FROM raw_polymarket""")
def _(spark, root):
    k = derived.raw_kalshi(spark, root).select(F.concat(F.lit("K"), "n").alias("external_id"), F.lit("kalshi").alias("platform"))
    p = derived.raw_polymarket(spark, root).select(F.concat(F.lit("P"), "n").alias("external_id"), F.lit("polymarket").alias("platform"), "slug")
    return k.unionByName(p, allowMissingColumns=True)


@query("h3_distinct_values", """
    SELECT 'platform' AS kind, platform AS value FROM markets GROUP BY 2 UNION ALL SELECT 'category', category FROM markets GROUP BY 2""")
def _(spark, root):
    m = derived.markets(spark, root)
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("platform", "category")]))
                    .alias("r")).select("r.*").distinct()


@query("h5_field_overlap", """
    SELECT * FROM (VALUES ('title', 'common'), ('id', 'common'), ('category', 'common'), ('volume', 'common'),
      ('ticker', 'only_left'), ('event_ticker', 'only_left'), ('subtitle', 'only_left'), ('status', 'only_left'), ('open_time', 'only_left'),
      ('close_time', 'only_left'), ('created_time', 'only_left'), ('yes_bid', 'only_left'), ('yes_ask', 'only_left'), ('no_bid', 'only_left'),
      ('no_ask', 'only_left'), ('last_price', 'only_left'), ('volume_24h', 'only_left'), ('liquidity', 'only_left'),
      ('open_interest', 'only_left'), ('can_close_early', 'only_left'), ('conditionId', 'only_right'), ('question', 'only_right'),
      ('description', 'only_right'), ('slug', 'only_right'), ('outcomes', 'only_right'), ('outcomePrices', 'only_right'),
      ('clobTokenIds', 'only_right'), ('lastTradePrice', 'only_right'), ('bestBid', 'only_right'), ('bestAsk', 'only_right'),
      ('volumeNum', 'only_right'), ('liquidityNum', 'only_right'), ('startDate', 'only_right'), ('createdAt', 'only_right'),
      ('endDate', 'only_right'), ('active', 'only_right'), ('closed', 'only_right'), ('archived', 'only_right'), ('tags', 'only_right'))
      t(field, presence)""")
def _(spark, root):
    from crossmarket.plans.listings import polymarket_envelopes
    return landing.field_overlap(kalshi_envelopes(spark, root), polymarket_envelopes(spark, root))


# --- repairs and maintenance -----------------------------------------------------------------

@query("j1_upsert_markets", """
    SELECT id, CASE WHEN is_active THEN volume + 1 ELSE volume END AS volume, category,
           CASE WHEN category = 'Sports' THEN 'inserted' WHEN is_active THEN 'updated' ELSE 'kept' END AS action
    FROM markets WHERE category <> 'Sports' OR is_active""")
def _(spark, root):
    m = derived.markets(spark, root)
    target = m.where("category <> 'Sports'").select("id", "volume", "category")
    source = m.where("is_active").select("id", (F.col("volume") + 1).alias("volume"), "category", F.lit(1).alias("version"))
    older = source.withColumn("volume", F.lit(-1.0)).withColumn("version", F.lit(0))
    return tables.upsert(target, source.unionByName(older), ["id"], ["version"], ["volume"])


@query("j1_upsert_counts", """
    SELECT count(*) AS total, count(*) FILTER (category = 'Sports') AS inserted, count(*) FILTER (category <> 'Sports') AS updated
    FROM markets WHERE is_active""")
def _(spark, root):
    m = derived.markets(spark, root)
    target = m.where("category <> 'Sports'").select("id", "volume")
    source = m.where("is_active").select("id", "volume", F.lit(1).alias("version"))
    return tables.upsert_counts(tables.upsert(target, source, ["id"], ["version"], ["volume"]))


@query("j5_price_log", """
    SELECT id, 'yes' AS outcome, CASE WHEN n % 2 = 0 THEN yes_price ELSE no_price END AS price, volume, NOT is_active AS is_first
    FROM markets WHERE NOT is_active OR (n % 2 = 1 AND yes_price <> no_price)""")
def _(spark, root):
    m = derived.markets(spark, root)
    source = m.select("id", "volume", F.when(F.col("n") % 2 == 0, F.col("yes_price")).otherwise(F.col("no_price")).alias("yes_price"))
    return tables.price_log(m.where("is_active").select("id", "yes_price"), source, ["id"])


SCALED = """SELECT n, platform, volume, liquidity, yes_price * CASE WHEN n % 3 = 0 THEN 100 ELSE 1 END AS yes_price,
    CASE WHEN n % 7 = 0 THEN 0.9 ELSE no_price END AS no_price FROM markets"""


def scaled(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("n")
    return derived.markets(spark, root).select(
        "n", "platform", "volume", "liquidity", (F.col("yes_price") * F.when(n % 3 == 0, 100).otherwise(1)).alias("yes_price"),
        F.when(n % 7 == 0, 0.9).otherwise(F.col("no_price")).alias("no_price"))


@query("j6_kalshi_price_repair", """
    SELECT n, y AS yes_price, CASE WHEN platform = 'kalshi' AND round(abs(y + no_price - 1), 9) > 0.01 THEN 1 - y ELSE no_price END AS no_price
    FROM (SELECT *, CASE WHEN platform = 'kalshi' AND yes_price > 1 THEN yes_price / 100 ELSE yes_price END AS y FROM scaled)""",
       r="yes_price no_price", views={"scaled": SCALED})
def _(spark, root):
    return tables.repair_kalshi_prices(scaled(spark, root)).select("n", "yes_price", "no_price")


@query("j7_no_price_and_volume_repair", """
    SELECT n, CASE WHEN platform = 'polymarket' AND yes_price BETWEEN 0 AND 1 AND (no_price = 0 OR round(abs(yes_price + no_price - 1), 9) > 0.1)
             THEN 1 - yes_price ELSE no_price END AS no_price,
           CASE WHEN platform = 'kalshi' AND volume = 0 AND liquidity > 0 THEN liquidity / 1000 ELSE volume END AS volume FROM scaled""",
       r="no_price", views={"scaled": SCALED})
def _(spark, root):
    return tables.repair_volumes(tables.repair_no_prices(scaled(spark, root))).select("n", "no_price", "volume")


def repaired_sql(wide: bool) -> str:
    arms = []
    for name, pattern in vocab.REPAIR_CATEGORY_REGEXES:
        words = pattern.split("|") + list(vocab.REPAIR_CATEGORY_EXTRA_WORDS.get(name, ()) if wide else ())
        arms.append("WHEN " + " OR ".join(f"contains(lower(title), '{w}') OR contains(lower(description), '{w}')" for w in words)
                    + f" THEN '{name}'")
    return f"CASE WHEN platform = 'polymarket' AND category = 'other' THEN CASE {' '.join(arms)} ELSE 'other' END ELSE category END"


@query("j8_category_repairs", f"""
    SELECT n, {repaired_sql(False)} AS by_regex, {repaired_sql(True)} AS by_words, CASE """
       + " ".join(f"WHEN contains(lower(title), '{w}') THEN '{c}'" for w, c in reversed(vocab.OVERRIDE_CATEGORY_WORDS))
       + " ELSE category END AS overridden FROM unified")
def _(spark, root):
    df = derived.unified(spark, root).select("n", "platform", "title", "description", "category")
    keep = lambda fixed, name: fixed.select("n", F.col("category").alias(name))
    return keep(tables.repair_categories(df), "by_regex").join(keep(tables.repair_categories(df, True), "by_words"), "n").join(
        keep(tables.override_categories(df), "overridden"), "n")


@query("j10_default_price_repair", """
    SELECT n, CASE WHEN yes_price IN (0, 1) THEN 0.5 ELSE yes_price END AS yes_price,
           CASE WHEN yes_price IN (0, 1) THEN 0.5 WHEN round(abs(yes_price + no_price - 1), 9) > 0.01 THEN 1 - yes_price ELSE no_price END AS no_price
    FROM raw_markets""", r="no_price", views=QV)
def _(spark, root):
    return tables.repair_default_prices(flawed(spark, root)).select("n", "yes_price", "no_price")


@query("j11_retention", f"""
    SELECT 'run_logs' AS table_name, count(*) FILTER (started_at < {T} - to_days(365)) AS deleted,
           count(*) FILTER (started_at >= {T} - to_days(365)) AS kept FROM run_logs""")
def _(spark, root):
    return tables.retention_counts(derived.run_logs(spark, root), "started_at", AS_OF, 365, "run_logs")


@query("j12_platform_seed", """
    SELECT platform AS name, count(*) AS listings FROM markets GROUP BY 1
    UNION ALL SELECT name, 0 FROM (VALUES ('predictit'), ('manifold')) t(name)""")
def _(spark, root):
    known = derived.markets(spark, root).groupBy(F.col("platform").alias("name")).agg(F.count(F.lit(1)).alias("listings"))
    return tables.seed_platforms(known, platforms(spark).select("name", F.lit(0).alias("listings")))


@query("j12_platform_patch", """
    SELECT platform AS name, count(*) AS listings, CASE platform WHEN 'kalshi' THEN 'syncing' ELSE 'idle' END AS sync_status,
           max(CASE WHEN platform = 'kalshi' THEN close_time ELSE open_time END) AS last_sync
    FROM markets GROUP BY platform""")
def _(spark, root):
    """What a sync reports replaces the columns it gives; what it leaves out stays."""
    m = derived.markets(spark, root)
    known = m.groupBy(F.col("platform").alias("name")).agg(F.count(F.lit(1)).alias("listings"), F.max("open_time").alias("last_sync"))
    known = known.withColumn("sync_status", F.lit("idle"))
    report = m.where("platform = 'kalshi'").groupBy(F.col("platform").alias("name")).agg(F.max("close_time").alias("last_sync"))
    changes = report.withColumn("sync_status", F.lit("syncing")).withColumn("listings", F.lit(None).cast("bigint"))
    return tables.patch(known, "name", changes)


@query("j13_run_state", """
    SELECT platform, stage, arg_max(status, (started_at, run_id)) AS status, max(started_at) AS started_at FROM run_logs GROUP BY 1, 2""")
def _(spark, root):
    logs = derived.run_logs(spark, root).select("platform", "stage", "status", "started_at", "run_id")
    return tables.latest_per_key(logs, ["platform", "stage"], ["started_at", "run_id"]).drop("run_id")


@query("j2_replace_similarities", "SELECT kalshi_id, polymarket_id, confidence_score FROM evals WHERE stage = 'deep_analysis'")
def _(spark, root):
    df = derived.evaluations(spark, root).select("kalshi_id", "polymarket_id", "confidence_score", "stage")
    old = df.where("stage = 'screening'").withColumn("status", F.lit("stale"))
    fresh = df.where("stage = 'deep_analysis'").withColumn("status", F.lit("fresh"))
    return tables.replace_active(old, fresh, "stale").drop("stage", "status")


@query("f9_latest_version", """
    SELECT market_id, outcome, arg_max(price, ("timestamp", event_id)) AS price, max("timestamp") AS "timestamp" FROM history GROUP BY 1, 2""")
def _(spark, root):
    df = derived.price_history(spark, root).select("market_id", "outcome", "price", "timestamp", "event_id")
    return tables.latest_per_key(df, ["market_id", "outcome"], ["timestamp", "event_id"]).drop("event_id")


@query("f8_latest_logs_per_key", """
    SELECT run_id, platform FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY started_at DESC, run_id DESC) AS rn FROM run_logs)
    WHERE rn <= 5""")
def _(spark, root):
    logs = derived.run_logs(spark, root)
    return tables.latest_n_per_key(logs, ["platform"], [F.desc("started_at"), F.desc("run_id")], 5).select("run_id", "platform")
