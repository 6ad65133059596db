"""Aggregate reports over listings, evaluations, opportunities and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.operators.ranks import median
from crossmarket.functions import vocab

def rows() -> Column:
    return F.count(F.lit(1))


def count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def confidence_band(bands: int, score: str = "confidence_score") -> Column:
    chain = None
    for label, low in vocab.CONFIDENCE_BANDS[bands][:-1]:
        hit = F.col(score) >= low
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(vocab.CONFIDENCE_BANDS[bands][-1][0])


def confidence_histogram(evals: DataFrame, bands: int) -> DataFrame:
    return evals.groupBy(confidence_band(bands).alias("confidence_range")).agg(
        rows().alias("pairs"), (F.avg("confidence_score") * 100).alias("avg_confidence"),
        count_if(F.col("is_equivalent"), "equivalent_count"), F.min("confidence_score").alias("lowest")).orderBy(
        F.desc("lowest"))


def stage_breakdown(evals: DataFrame) -> DataFrame:
    """Needs price_difference."""
    return evals.groupBy("stage").agg(
        rows().alias("total_pairs"), F.avg("confidence_score").alias("avg_confidence"),
        count_if(F.col("confidence_score") >= 0.7, "high_confidence"),
        count_if(F.col("is_equivalent"), "equivalent_pairs"), F.avg("price_difference").alias("avg_price_diff"))


def category_matrix(evals: DataFrame, least: int = 3) -> DataFrame:
    return evals.groupBy("kalshi_category", "polymarket_category").agg(
        rows().alias("pairs_evaluated"), F.avg("confidence_score").alias("avg_confidence"),
        F.max("confidence_score").alias("max_confidence"),
        count_if(F.col("is_equivalent"), "equivalent_count")).where(F.col("pairs_evaluated") >= least)


def evaluation_totals(evals: DataFrame) -> DataFrame:
    return evals.agg(
        rows().alias("total_evaluations"), F.avg("confidence_score").alias("avg_confidence"),
        count_if(F.col("is_equivalent"), "total_equivalent"), F.sum("min_volume").alias("addressable_volume"),
        F.countDistinct("kalshi_category").alias("kalshi_categories"),
        F.countDistinct("polymarket_category").alias("polymarket_categories"))


def confidence_median(evals: DataFrame) -> DataFrame:
    """Mean, exact median and how many reach one half; the median by ranks over counts per score (see ranks)."""
    plain = evals.agg(F.avg("confidence_score").alias("avg_confidence"),
                      count_if(F.col("confidence_score") >= 0.5, "medium_plus")).withColumn("_j", F.lit(1))
    middle = median(evals, "confidence_score").withColumnRenamed("median", "median_confidence").withColumn("_j", F.lit(1))
    return plain.join(middle, "_j").drop("_j")


def opportunity_summary(opps: DataFrame) -> DataFrame:
    return opps.agg(
        rows().alias("total"), count_if(F.col("potential_profit") > 0.05, "high_profit"),
        F.avg("potential_profit").alias("avg_profit"), F.max("potential_profit").alias("max_profit"),
        F.avg("confidence_score").alias("avg_confidence"), F.sum("min_volume").alias("total_volume"))


def opportunity_by_category(opps: DataFrame) -> DataFrame:
    return opps.groupBy("kalshi_category").agg(rows().alias("opportunities"), F.avg("potential_profit").alias("avg_profit"))


def evaluation_run_stats(evals: DataFrame, tokens_in: str, tokens_out: str, rate_in: float = 0.03,
                         rate_out: float = 0.06, accept: float = 0.75) -> DataFrame:
    """Filter and success rates and cost totals at a price per thousand tokens."""
    cost = F.col(tokens_in) / 1000 * rate_in + F.col(tokens_out) / 1000 * rate_out
    answered = F.col("confidence_score").isNotNull()
    return evals.agg(
        rows().alias("evaluated"), count_if(F.col("confidence_score") >= accept, "accepted"),
        (1 - F.count_if(F.col("confidence_score") >= accept) / rows()).alias("filter_rate"),
        count_if(answered, "successful"), count_if(~answered, "failed"), F.sum(cost).alias("total_cost"),
        (F.sum(cost) / rows()).alias("cost_per_evaluation"))


def batch_log(evals: DataFrame, stage: str) -> DataFrame:
    """The processing-log row of one evaluated stage."""
    done = evals.where(F.col("stage") == stage)
    return done.agg(F.lit(stage).alias("stage"), rows().alias("output_pairs"), F.avg("confidence_score").alias("avg_confidence"),
                    count_if(F.col("confidence_score") >= 0.7, "high_confidence_count"))


def platform_validation(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(
        rows().alias("total"), count_if(F.col("is_active"), "active"), F.avg("volume").alias("avg_volume"),
        F.avg("liquidity").alias("avg_liquidity"), count_if(F.col("yes_price").between(0.01, 0.99), "valid_prices"))


def grand_totals(df: DataFrame) -> DataFrame:
    return df.agg(rows().alias("total"), F.countDistinct("platform").alias("platforms"),
                  F.countDistinct("category").alias("categories"), F.avg("yes_price").alias("avg_yes_price"),
                  F.avg("volume").alias("avg_volume"))


def category_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("platform", "category").agg(rows().alias("markets")).orderBy("platform", F.desc("markets"), "category")


def platform_overview(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(
        rows().alias("market_count"), F.avg("yes_price").alias("avg_yes_price"), F.avg("volume").alias("avg_volume"),
        F.min("open_time").alias("earliest"), F.max("open_time").alias("latest"))


def markets_per_day(df: DataFrame, limit: int = 10) -> DataFrame:
    day = F.to_date("open_time")
    return df.where(day.isNotNull()).groupBy(day.cast("string").alias("market_date")).agg(
        rows().alias("markets_created"), F.avg("volume").alias("avg_volume")).orderBy(F.desc("market_date")).limit(limit)


def description_coverage(df: DataFrame, rich: int = 50) -> DataFrame:
    return df.groupBy("platform").agg(
        rows().alias("total"), count_if(F.length("description") > rich, "rich_descriptions"),
        F.avg(F.length("description")).alias("avg_length"))


def load_verification(df: DataFrame) -> DataFrame:
    high = (((F.col("platform") == "polymarket") & (F.col("volume") > 1000))
            | ((F.col("platform") == "kalshi") & (F.col("volume") > 100)))
    return df.groupBy("platform").agg(
        rows().alias("markets"), F.countDistinct("category").alias("categories"), F.avg("volume").alias("avg_volume"),
        count_if(high, "high_volume_count"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(rows().alias("copies")).where(F.col("copies") > 1)


def fetch_times(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("api_status") == 200).groupBy("platform").agg(
        F.avg("processing_time_ms").alias("avg_time_ms"))


def coverage_and_quality(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(
        rows().alias("total"), F.countDistinct("category").alias("unique_categories"), F.max("volume").alias("max_volume"),
        count_if(F.col("volume") > 0, "with_volume"), count_if(F.col("yes_price").between(0.01, 0.99), "valid_prices"),
        count_if(F.col("category") != "other", "categorized"), count_if(F.length("title") > 10, "good_titles"),
        count_if(F.col("close_time").isNotNull(), "has_end_date"))


def volume_profile(df: DataFrame, key: str) -> DataFrame:
    volume, liquidity = F.col("volume"), F.col("liquidity")
    return df.groupBy(key).agg(
        rows().alias("total"), count_if(volume > 0, "with_volume"), F.min(volume).alias("min_volume"),
        F.max(volume).alias("max_volume"), F.avg(volume).alias("avg_volume"),
        F.avg(F.when(volume > 0, volume)).alias("avg_nonzero_volume"), count_if(volume > 100, "over_100"),
        count_if(volume > 1000, "over_1000"), F.avg(liquidity).alias("avg_liquidity"),
        F.avg(F.when(liquidity > 0, liquidity)).alias("avg_nonzero_liquidity"))


def proxy_consistency(df: DataFrame) -> DataFrame:
    v, q = F.col("volume"), F.col("liquidity")
    return df.agg(rows().alias("total"), count_if(F.abs(v - q / 1000.0) < 0.01, "matches_formula"),
                  count_if((v == 0) & (q == 0), "both_zero"), count_if((v > 0) & (q == 0), "volume_only"),
                  count_if((v == 0) & (q > 0), "liquidity_only"))


def active_range(df: DataFrame) -> DataFrame:
    """Ranges over active listings; zeros when there are none."""
    live = df.where(F.col("status") == "active")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return live.agg(rows().alias("total_markets"), zero(F.min("volume")).alias("min_volume"),
                    zero(F.max("volume")).alias("max_volume"), zero(F.min("liquidity")).alias("min_liquidity"),
                    zero(F.max("liquidity")).alias("max_liquidity"))


def market_stats(markets: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(measure, key, value): totals, and one row per platform and category, however many there are."""
    def measures(totals: DataFrame) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("key"),
                                            F.col(c).cast("double").alias("value")) for c in totals.columns]))
        return totals.select(rows.alias("r")).select("r.*")

    result = measures(markets.agg(rows().alias("total_markets"), count_if(F.col("is_active"), "active_markets")))
    result = result.unionByName(measures(opportunities.agg(
        rows().alias("total_opportunities"), F.coalesce(F.avg("profit_margin"), F.lit(0.0)).alias("avg_profit_margin"))))
    for key in ("platform", "category"):
        result = result.unionByName(markets.groupBy(F.col(key).alias("key")).agg(rows().cast("double").alias("value")).select(
            F.lit(f"{key}_count").alias("measure"), "key", "value"))
    return result


def field_availability(raw: DataFrame, fields: list[str]) -> DataFrame:
    counts = raw.agg(rows().alias("total"), *[F.count(c).alias(c) for c in fields])
    table = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present"),
                                        (F.col(c) / F.col("total") * 100).alias("share_pct")) for c in fields]))
    return counts.select(table.alias("r")).select("r.*")


def repair_validation(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(
        rows().alias("total"), count_if(F.col("yes_price").between(0.01, 0.99), "valid_yes"),
        count_if(F.col("no_price").between(0.01, 0.99), "valid_no"),
        count_if(F.round(F.abs(F.col("yes_price") + F.col("no_price") - 1.0), 9) <= 0.01, "valid_sums"),
        count_if(F.col("category") != "other", "categorized"), count_if(F.col("volume") > 0, "has_volume"),
        F.avg("volume").alias("avg_volume"))


def stage_metrics(logs: DataFrame, as_of: str, days: int) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return logs.where(F.col("started_at").cast("timestamp") >= since).groupBy("stage").agg(
        rows().alias("executions"), F.avg("processing_time_ms").alias("avg_processing_time"),
        F.sum("input_count").alias("total_input"), F.sum("output_count").alias("total_output"),
        F.avg(F.try_divide(F.col("output_count").cast("double"), F.nullif("input_count", F.lit(0)))).alias("avg_efficiency"))


def execution_history(logs: DataFrame, limit: int = 10) -> DataFrame:
    return logs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def top_titles(df: DataFrame, keep: int = 3) -> DataFrame:
    """Per category: count, volume and the titles of its largest listings."""
    order = Window.partitionBy("category").orderBy(F.desc("volume"), "id")
    best = (df.select("category", "volume", "id", "title").withColumn("rn", F.row_number().over(order))
            .where(F.col("rn") <= keep).groupBy("category")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "title"))), lambda t: t["title"]).alias("top_markets")))
    totals = df.groupBy("category").agg(rows().alias("market_count"), F.sum("volume").alias("total_volume"))
    return totals.join(best, "category")


def created_trend(df: DataFrame, width: str = "7 days") -> DataFrame:
    return df.groupBy(F.window(F.col("open_time").cast("timestamp"), width).alias("w")).agg(
        rows().alias("markets"), F.avg("volume").alias("avg_volume")).select(
        F.col("w.start").alias("window_start"), "markets", "avg_volume")


def confidence_levels(opps: DataFrame) -> DataFrame:
    score = F.col("confidence_score")
    return opps.agg(rows().alias("total_found"), count_if(score > 0.8, "high"),
                    count_if((score >= 0.6) & (score <= 0.8), "medium"), count_if(score < 0.6, "low"))
