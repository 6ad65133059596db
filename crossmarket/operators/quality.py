"""Data-quality checks as tables of (metric, platform, value, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expected minima and thresholds per venue.
MIN_MARKETS = {"kalshi": 4000, "polymarket": 8000}
COMPLETENESS = {  # field: (kalshi, polymarket)
    "Title": (95, 95), "Yes Price": (80, 90), "No Price": (80, 90), "Volume": (15, 85),
    "Liquidity": (70, 25), "Category": (90, 90), "End Date": (95, 95)}
ANOMALIES = {  # check: (kalshi, polymarket)
    "Short Titles (<10 chars)": (5, 5), "Long Titles (>200 chars)": (1, 1),
    "Default Prices (0.5/0.5)": (20, 10), "Invalid Price Sums": (1, 1), "Uncategorized Markets": (30, 30)}
VOLUME_COVERAGE = {"kalshi": 15, "polymarket": 80}
LIQUIDITY_COVERAGE = {"kalshi": 70, "polymarket": 25}


def per_venue(values: dict[str, float] | tuple[float, float]) -> Column:
    kalshi, other = (values["kalshi"], values["polymarket"]) if isinstance(values, dict) else values
    return F.when(F.col("platform") == "kalshi", kalshi).otherwise(other)


def nonempty(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def percent(part: str | Column, whole: str | Column = "total") -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.round(F.round(part / (F.col(whole) if isinstance(whole, str) else whole) * 100, 9), 1)


def long_table(df: DataFrame, items: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per (metric, platform) from columns of a per-platform aggregate."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"),
                                        s.alias("status")) for n, v, s in items]))
    return df.select("platform", rows.alias("r")).select("r.metric", "platform", "r.value", "r.status")


def coverage(df: DataFrame) -> DataFrame:
    counts = df.groupBy("platform").agg(F.count(F.lit(1)).alias("total"))
    few = F.col("total") < per_venue(MIN_MARKETS)
    return long_table(counts, [("Total Markets", F.col("total"), F.when(few, "WARN").otherwise("PASS"))])


def completeness(df: DataFrame) -> DataFrame:
    """Share of rows with each field, against the venue's expectation."""
    filled = {
        "Title": nonempty("title"), "Yes Price": F.col("yes_price") > 0, "No Price": F.col("no_price") > 0,
        "Volume": F.col("volume") >= 0, "Liquidity": F.col("liquidity") > 0, "Category": nonempty("category"),
        "End Date": F.col("end_date").isNotNull()}
    counts = df.groupBy("platform").agg(F.count(F.lit(1)).alias("total"),
                                        *[F.count_if(c).alias(n) for n, c in filled.items()])

    def status(name: str) -> Column:
        share, want = F.col(name) / F.col("total") * 100, per_venue(COMPLETENESS[name])
        return F.when(share >= want, "PASS").when(share >= want - 10, "WARN").otherwise("FAIL")

    return long_table(counts, [(f"{n} Completeness", percent(n), status(n)) for n in filled])


def anomalies(df: DataFrame, all_rows: bool = False) -> DataFrame:
    """Anomaly rates; only those above their threshold unless all_rows."""
    odd = {
        "Short Titles (<10 chars)": F.length("title") < 10, "Long Titles (>200 chars)": F.length("title") > 200,
        "Default Prices (0.5/0.5)": (F.col("yes_price") == 0.5) & (F.col("no_price") == 0.5),
        "Invalid Price Sums": F.round(F.col("yes_price") + F.col("no_price"), 9) != 1.0,
        "Uncategorized Markets": F.col("category") == "other"}
    counts = df.groupBy("platform").agg(F.count(F.lit(1)).alias("total"),
                                        *[F.count_if(c).alias(n) for n, c in odd.items()])

    def status(name: str) -> Column:
        share, limit = F.col(f"`{name}`") / F.col("total") * 100, per_venue(ANOMALIES[name])
        return F.when(share <= limit, "PASS").when(share <= limit * 2, "WARN").otherwise("FAIL")

    table = long_table(counts, [(n, percent(F.col(f"`{n}`")), status(n)) for n in odd])
    return table if all_rows else table.where(F.col("status") != "PASS")


def price_stats(df: DataFrame) -> DataFrame:
    p = F.col("yes_price")
    return df.where(p.isNotNull()).groupBy("platform").agg(
        F.count(F.lit(1)).alias("total"), F.avg(p).alias("avg_yes_price"), F.min(p).alias("min_yes_price"),
        F.max(p).alias("max_yes_price"), F.stddev(p).alias("std_yes_price"),
        F.count_if(p.between(0.01, 0.99)).alias("valid_yes_prices"))


def price_checks(df: DataFrame) -> DataFrame:
    stats = price_stats(df)
    valid = F.col("valid_yes_prices") / F.col("total") * 100
    range_status = F.when(valid < 60, "FAIL").when(valid < 80, "WARN").otherwise("PASS")
    diverse = F.when(F.abs(F.col("avg_yes_price") - 0.5) < 0.05, "WARN").otherwise("PASS")
    return long_table(stats, [("Valid Price Range", percent("valid_yes_prices"), range_status),
                              ("Price Diversity", F.round("avg_yes_price", 3), diverse)])


def volume_checks(df: DataFrame) -> DataFrame:
    counts = df.groupBy("platform").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("volume") > 0).alias("has_volume"),
        F.count_if(F.col("liquidity") > 0).alias("has_liquidity"))

    def status(name: str, expected: dict[str, float]) -> Column:
        share, want = F.col(name) / F.col("total") * 100, per_venue(expected)
        return F.when(share >= want, "PASS").when(share < want - 20, "FAIL").otherwise("WARN")

    return long_table(counts, [
        ("Volume Coverage", percent("has_volume"), status("has_volume", VOLUME_COVERAGE)),
        ("Liquidity Coverage", percent("has_liquidity"), status("has_liquidity", LIQUIDITY_COVERAGE))])


def category_shares(df: DataFrame, keep: int = 5) -> DataFrame:
    """Largest categories per venue with their share of its rows."""
    counts = df.groupBy("platform", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("avg_volume"))
    venue = Window.partitionBy("platform")
    order = venue.orderBy(F.desc("n"), "category")
    return (counts.withColumn("share_pct", percent("n", F.sum("n").over(venue)))
            .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep))


def category_check(df: DataFrame) -> DataFrame:
    counts = df.groupBy("platform").agg(F.count(F.lit(1)).alias("total"),
                                        F.count_if(F.col("category") == "other").alias("other"))
    share = F.col("other") / F.col("total") * 100
    return long_table(counts, [("Category Classification", percent("other"), F.when(share > 70, "FAIL").when(
        share > 50, "WARN").otherwise("PASS"))])


def cross_venue(df: DataFrame) -> DataFrame:
    """Totals and averages of both venues side by side with their ratio (one aggregation)."""
    mine = lambda v, c: F.avg(F.when(F.col("platform") == v, F.col(c)))
    count = lambda v: F.count_if(F.col("platform") == v).cast("double")
    row = df.agg(*[f.alias(f"{m}_{v}") for v in ("kalshi", "polymarket")
                   for m, f in (("n", count(v)), ("vol", mine(v, "volume")), ("liq", mine(v, "liquidity")))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(f"{m}_kalshi").alias("kalshi_value"),
                 F.col(f"{m}_polymarket").alias("polymarket_value"))
        for label, m in (("Total Markets", "n"), ("Avg Volume", "vol"), ("Avg Liquidity", "liq"))]))
    table = row.select(rows.alias("r")).select("r.*")
    ratio = F.try_divide("polymarket_value", "kalshi_value")
    off = (F.col("metric") == "Total Markets") & ((F.col("ratio") < 1.5) | (F.col("ratio") > 3))
    return table.withColumn("ratio", F.round(ratio, 6)).withColumn("status", F.when(off, "WARN").otherwise("PASS"))


def all_checks(df: DataFrame) -> DataFrame:
    """Every check as one long table."""
    tables = [coverage(df), completeness(df), anomalies(df), price_checks(df).where("status <> 'PASS'"),
              volume_checks(df).where("status <> 'PASS'"), category_check(df).where("status <> 'PASS'"),
              cross_venue(df).where("status <> 'PASS'").select(
                  F.lit("Market Count Ratio").alias("metric"), F.lit("Cross-platform").alias("platform"),
                  F.round("ratio", 2).alias("value"), "status")]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def verdict(checks: DataFrame) -> DataFrame:
    counts = checks.agg(F.count(F.lit(1)).alias("total_checks"),
                        *[F.count_if(F.col("status") == s).alias(n) for n, s in
                          (("passed", "PASS"), ("warnings", "WARN"), ("failed", "FAIL"))])
    return counts.withColumn("overall_status", F.when(F.col("failed") > 0, "NEEDS ATTENTION").when(
        F.col("warnings") > 3, "REVIEW RECOMMENDED").otherwise("GOOD"))


def quality_score(checks: DataFrame, minimum: float = 0.8) -> DataFrame:
    """Share of passed checks and whether it is too low."""
    score = checks.agg(F.avg((F.col("status") == "PASS").cast("double")).alias("score"))
    return score.withColumn("alert", F.col("score") < minimum)


def duration_alert(logs: DataFrame, limit_seconds: float = 300.0) -> DataFrame:
    mean = logs.agg((F.avg("processing_time_ms") / 1000).alias("avg_seconds"))
    return mean.withColumn("alert", F.col("avg_seconds") > limit_seconds)
