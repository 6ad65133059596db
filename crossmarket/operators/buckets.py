"""Blocking keys: which topical bucket a listing belongs to, and what buckets look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.config import BucketConfig
from crossmarket.functions import text, vocab
from crossmarket.functions.text import contains_all, contains_any, count_hits

MISC = "miscellaneous"


def bucket_points(bucket: vocab.Bucket, body: Column, category: Column, end: Column, start: Column,
                  cfg: BucketConfig) -> Column:
    """0-100 fit of a listing to one bucket."""
    keywords = F.least(F.lit(cfg.keyword_cap),
                       count_hits(body, bucket.keywords) / len(bucket.keywords) * cfg.keyword_scale)
    exact = category.isin(*bucket.categories)
    partial = contains_any(F.lower(category), [c.lower() for c in bucket.categories])
    points = keywords + F.when(exact, cfg.category_exact).when(
        partial, cfg.category_partial).otherwise(0.0)
    if bucket.window_start:
        since = F.lit(bucket.window_start).cast("timestamp")
        points = points + F.when(end >= since, cfg.window_end).when(
            start >= since, cfg.window_start).otherwise(0.0)
    points = F.least(F.lit(100.0), points)
    vetoed = F.lit(False)
    if bucket.required:
        vetoed = vetoed | ~contains_all(body, bucket.required)
    if bucket.excluded:
        vetoed = vetoed | contains_any(body, bucket.excluded)
    return F.when(vetoed, F.lit(0.0)).otherwise(F.coalesce(points, F.lit(0.0)))


def body_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.lower(title), F.lower(F.coalesce(description, F.lit(""))))


def best_bucket(body: Column, category: Column, end: Column, start: Column, cfg: BucketConfig = BucketConfig(),
                buckets: tuple[vocab.Bucket, ...] = vocab.BUCKETS) -> Column:
    """Struct (bucket, confidence) from one fold over the buckets in definition order.

    A bucket wins when its points plus priority boost exceed the points stored so far; what is
    stored are the points without the boost, so later buckets can displace better ones.
    """
    scored = F.array(*[
        F.struct(F.lit(b.name).alias("name"),
                 F.lit(float((5 - b.priority) * 5 if cfg.use_boost else 0)).alias("boost"),
                 bucket_points(b, body, category, end, start, cfg).alias("points"))
        for b in buckets])
    initial = F.struct(F.lit(MISC).alias("name"), F.lit(0.0).alias("points"))

    def step(best: Column, b: Column) -> Column:
        enough = b["points"] > cfg.min_score if cfg.strict_minimum else b["points"] >= cfg.min_score
        wins = (b["points"] + b["boost"] > best["points"]) & enough
        return F.struct(F.when(wins, b["name"]).otherwise(best["name"]).alias("name"),
                        F.when(wins, b["points"]).otherwise(best["points"]).alias("points"))

    return F.aggregate(scored, initial, step, lambda best: F.struct(
        best["name"].alias("bucket"), (best["points"] / 100.0).alias("confidence")))


def with_bucket(markets: DataFrame, cfg: BucketConfig = BucketConfig(),
                buckets: tuple[vocab.Bucket, ...] = vocab.BUCKETS) -> DataFrame:
    """Adds bucket and bucket_confidence.

    The searched text is a column of its own, so that it is built once per row and not once per
    keyword.
    """
    folded = best_bucket(F.col("_body"), F.col("category"), F.col("close_time"), F.col("open_time"), cfg, buckets)
    return (markets.withColumn("_body", body_text(F.col("title"), F.col("description")))
            .withColumn("_b", folded).withColumn("bucket", F.col("_b.bucket"))
            .withColumn("bucket_confidence", F.col("_b.confidence")).drop("_b", "_body"))


def keyword_bucket(title: Column, category: Column) -> Column:
    """Title-keyword rules first, then the category fallback."""
    low = F.lower(title)
    chain = None
    for name, alternatives in vocab.KEYWORD_BUCKETS:
        hit = F.lit(False)
        for words in alternatives:
            hit = hit | contains_all(low, words)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    for listed, name in vocab.CATEGORY_BUCKETS.items():
        chain = chain.when(category == listed, name)
    return chain.otherwise(MISC)


def tradable(markets: DataFrame, min_volume: float = 50.0, low: float = 0.05,
             high: float = 0.95) -> DataFrame:
    """Active listings with some volume and a price away from certainty."""
    return markets.where(F.col("is_active") & (F.col("volume") > min_volume)
                         & F.col("yes_price").between(low, high))


def with_keyword_bucket(markets: DataFrame) -> DataFrame:
    return tradable(markets).withColumn("bucket", keyword_bucket(F.col("title"), F.col("category")))


def in_bucket(bucketed: DataFrame, bucket: str, platform: str | None = None) -> DataFrame:
    found = bucketed.where(F.col("bucket") == bucket)
    return found if platform is None else found.where(F.col("platform") == platform)


def stale(markets: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Listings without a bucket or last processed before the cutoff."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    missing = F.col("bucket").isNull() | (F.col("bucket") == "") | F.col("processed_at").isNull()
    return markets.where(missing | (F.col("processed_at") < cutoff))


def rebucket_stale(markets: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return with_bucket(stale(markets, as_of, hours).drop("bucket")).withColumn(
        "processed_at", F.lit(as_of).cast("timestamp"))


def venue_counts(bucketed: DataFrame) -> DataFrame:
    """One row per bucket with both venues' counts (pivot, missing is 0)."""
    count = lambda p: F.count_if(F.col("platform") == p)
    return bucketed.groupBy("bucket").agg(
        count("kalshi").alias("kalshi_count"), count("polymarket").alias("polymarket_count"),
        F.count(F.lit(1)).alias("total_markets"), F.avg("bucket_confidence").alias("avg_confidence"))


def bucket_stats(bucketed: DataFrame, samples: int = 3, keep: int = 5) -> DataFrame:
    """Counts, mean confidence and sample titles per bucket (first titles per venue, sorted)."""
    per_venue = bucketed.groupBy("bucket", "platform", "title").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bucket_confidence").alias("s"))
    rank = F.row_number().over(Window.partitionBy("bucket", "platform").orderBy("title"))
    titles = (per_venue.select("bucket", "platform", "title").withColumn("rn", rank)
              .where(F.col("rn") <= samples).groupBy("bucket")
              .agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("platform", "rn", "title"))),
                                       lambda t: t["title"]), 1, keep).alias("sample_titles")))
    return venue_counts(bucketed).join(titles, "bucket")


def bucket_pairs(bucketed: DataFrame) -> DataFrame:
    """Comparable buckets with their comparison counts, the largest first."""
    counts = venue_counts(bucketed.where(F.col("bucket") != MISC))
    return (counts.where((F.col("kalshi_count") > 0) & (F.col("polymarket_count") > 0))
            .select("bucket", "kalshi_count", "polymarket_count",
                    (F.col("kalshi_count") * F.col("polymarket_count")).alias("comparison_count"))
            .orderBy(F.desc("comparison_count"), "bucket"))


def bucket_effectiveness(bucketed: DataFrame) -> DataFrame:
    """Efficiency of every bucket with markets: twice the smaller venue over the total."""
    counts = venue_counts(bucketed)
    return counts.select(
        "bucket", "total_markets",
        (F.least("kalshi_count", "polymarket_count") * 2 / F.col("total_markets")).alias("efficiency_score"),
        (F.col("kalshi_count") * F.col("polymarket_count")).alias("potential_comparisons"),
        "avg_confidence")


def bucket_overview(bucketed: DataFrame,
                    buckets: tuple[vocab.Bucket, ...] = vocab.BUCKETS) -> DataFrame:
    """Numbers of used, cross-venue and empty buckets."""
    used = venue_counts(bucketed).agg(
        F.count(F.lit(1)).alias("active_buckets"),
        F.count_if((F.col("kalshi_count") > 0) & (F.col("polymarket_count") > 0)).alias("cross_platform_buckets"),
        F.count_if(F.col("bucket") != MISC).alias("_defined"))
    return used.select("active_buckets", "cross_platform_buckets",
                       (F.lit(len(buckets)) - F.col("_defined")).alias("empty_buckets"))


def keyword_bucket_distribution(markets: DataFrame) -> DataFrame:
    return with_keyword_bucket(markets).groupBy("bucket", "platform").agg(
        F.count(F.lit(1)).alias("market_count"), F.avg("volume").alias("avg_volume"),
        F.sum("volume").alias("total_volume"))


def bucket_comparisons(markets: DataFrame) -> DataFrame:
    """Per keyword bucket, how many comparisons blocking leaves."""
    count = lambda p: F.count_if(F.col("platform") == p)
    counts = with_keyword_bucket(markets).groupBy("bucket").agg(
        count("kalshi").alias("kalshi_count"), count("polymarket").alias("polymarket_count"))
    return counts.withColumn("comparisons", F.col("kalshi_count") * F.col("polymarket_count"))


def reduction_report(markets: DataFrame) -> DataFrame:
    """Comparisons with and without blocking, the reduction and what it saves."""
    active = markets.where("is_active").agg(
        F.count_if(F.col("platform") == "kalshi").alias("k"),
        F.count_if(F.col("platform") == "polymarket").alias("p"))
    blocked = bucket_comparisons(markets).agg(F.sum("comparisons").alias("optimized_comparisons"))
    both = active.withColumn("_j", F.lit(1)).join(blocked.withColumn("_j", F.lit(1)), "_j")
    now, later = F.col("k") * F.col("p"), F.coalesce("optimized_comparisons", F.lit(0))
    return both.select(
        now.alias("current_comparisons"), later.alias("optimized_comparisons"),
        ((1 - F.try_divide(later, now)) * 100).alias("reduction_pct"),
        ((now - later) / 60000.0).alias("minutes_saved"), ((now - later) * 0.001).alias("cost_saved"))
