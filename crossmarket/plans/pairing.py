"""Registered queries: buckets, pairs, the staged filter, scores and pair joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.config import DOC_BUCKETS, BucketConfig, FilterConfig
from crossmarket.functions import dates, prices, text, vocab
from crossmarket.operators import buckets, candidates, enrich, scoring, staged_filter  # noqa: F401
from crossmarket.plans import sqltext as sq
from crossmarket.plans.oracle_views import T
from crossmarket.plans.registry import query
from crossmarket.sources import derived
from crossmarket.sources.checkpoints import cut
from crossmarket.sources.derived import AS_OF

TRADABLE = "is_active AND volume > 50 AND yes_price BETWEEN 0.05 AND 0.95"
K1 = sq.bucket_steps(BucketConfig())
GAP = "round(abs(k.yes_price - p.yes_price), 6)"
RATIO = "least(k.volume, p.volume) / greatest(k.volume, p.volume)"
APART = "abs(CAST(epoch(k.close_time) AS BIGINT) - CAST(epoch(p.close_time) AS BIGINT))"

PAIR_VIEWS = {
    **K1,
    "tok": f"""SELECT *, {sq.tokens('title', vocab.JACCARD_STOP_WORDS)} AS words, {sq.tokens('title')} AS all_words,
               {sq.liquidity_score('volume', 'yes_price')} AS liq FROM bucketed WHERE bucket <> 'miscellaneous'""",
    "ready": "SELECT * FROM tok WHERE yes_price BETWEEN 0.05 AND 0.95 AND volume >= 100",
    "formed": f"""SELECT {sq.PAIR_SIDES}, k.bucket, k.n AS k, p.n AS p, {GAP} AS price_difference,
               {sq.jaccard('k.words', 'p.words')} * 0.7 AS text_similarity, k.all_words AS kw, p.all_words AS pw,
               (k.liq + p.liq) / 2 AS liquidity_score, {RATIO} AS volume_ratio, {APART} AS apart,
               epoch(k.close_time) - epoch({T}) AS k_left, epoch(p.close_time) - epoch({T}) AS p_left
               FROM ready k JOIN ready p ON k.bucket = p.bucket
               WHERE k.platform = 'kalshi' AND p.platform = 'polymarket' AND {GAP} >= 0.02""",
    "staged": """SELECT *, least(1.0::DOUBLE, 1.0::DOUBLE - apart / 2592000.0::DOUBLE
                   + CASE WHEN k_left < 86400 AND p_left < 86400 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
                   AS time_alignment_score, round(price_difference - 0.01, 6) AS arbitrage_potential
                 FROM formed WHERE (text_similarity >= 0.3 OR price_difference >= 0.1) AND liquidity_score >= 0.1
                   AND volume_ratio >= 0.1 AND apart <= 2592000 AND round(price_difference - 0.01, 6) >= 0.02""",
    "featured": """SELECT *, CASE WHEN len(list_intersect(kw, pw)) = 0 THEN 0.0::DOUBLE ELSE
                   len(list_intersect(kw, pw)) / sqrt(len(kw) * len(pw)) END AS cosine_similarity,
                   len(list_filter(list_intersect(kw, pw), lambda w: NOT list_contains(""" + sq.ARRAY(vocab.OVERLAP_STOP_WORDS)
                + """, w))) AS keyword_overlap_count,
                   lower(kalshi_category) = lower(polymarket_category) AS category_match,
                   apart / 3600.0::DOUBLE AS close_time_difference_hours,
                   k_left <= 86400 AND p_left <= 86400 AS both_closing_soon,
                   CASE bucket """ + " ".join(f"WHEN '{b}' THEN {r}::DOUBLE" for b, r in vocab.BUCKET_SUCCESS_RATES.items())
                + """ ELSE 0.6::DOUBLE END AS rate FROM staged""",
    "scored": """SELECT *, least(1.0::DOUBLE, ((text_similarity * 0.6 + cosine_similarity * 0.4) * 40
                   + least(1.0::DOUBLE, price_difference * 10) * 30 + CASE WHEN category_match THEN 20 ELSE 0 END
                   + volume_ratio * 10) / 100) AS worthiness FROM featured""",
}


def bucketed_once(spark: SparkSession, root: str) -> DataFrame:
    """Listings with their bucket, for readers that make one pass."""
    return buckets.with_bucket(derived.markets(spark, root))


def bucketed(spark: SparkSession, root: str) -> DataFrame:
    return cut(bucketed_once(spark, root))


def blocked(spark: SparkSession, root: str) -> DataFrame:
    """Listings in a named bucket."""
    return bucketed(spark, root).where(F.col("bucket") != buckets.MISC)


def staged(spark: SparkSession, root: str) -> DataFrame:
    return staged_filter.filter_pairs(blocked(spark, root), AS_OF)


def scored(spark: SparkSession, root: str) -> DataFrame:
    return scoring.score_pairs(staged(spark, root), AS_OF)


# --- buckets ---------------------------------------------------------------------------------

@query("k1_topical_buckets", "SELECT n, bucket, bucket_confidence FROM bucketed", r="bucket_confidence", views=K1)
def _(spark, root):
    return bucketed_once(spark, root).select("n", "bucket", "bucket_confidence")


@query("k2_keyword_buckets", f"SELECT n, {sq.keyword_bucket()} AS bucket FROM markets WHERE {TRADABLE}")
def _(spark, root):
    return buckets.with_keyword_bucket(derived.markets(spark, root)).select("n", "bucket")


@query("k3_documented_buckets", "SELECT n, bucket, bucket_confidence FROM bucketed", r="bucket_confidence",
       views=sq.bucket_steps(DOC_BUCKETS))
def _(spark, root):
    return buckets.with_bucket(derived.markets(spark, root), DOC_BUCKETS).select("n", "bucket", "bucket_confidence")


COUNTS = """SELECT bucket, count(*) FILTER (platform = 'kalshi') AS kalshi_count,
    count(*) FILTER (platform = 'polymarket') AS polymarket_count, count(*) AS total_markets,
    avg(bucket_confidence) AS avg_confidence FROM bucketed GROUP BY bucket"""


@query("e1_bucket_stats", """
    SELECT c.*, s.sample_titles FROM counts c JOIN (
      SELECT bucket, array_to_string((list(title ORDER BY platform, rn))[1:5], ',') AS sample_titles FROM (
        SELECT bucket, platform, title, row_number() OVER (PARTITION BY bucket, platform ORDER BY title) AS rn
        FROM (SELECT DISTINCT bucket, platform, title FROM bucketed)) WHERE rn <= 3 GROUP BY bucket) s USING (bucket)""",
       r="avg_confidence", views={**K1, "counts": COUNTS})
def _(spark, root):
    return buckets.bucket_stats(bucketed(spark, root))


@query("e2_bucket_pair_counts", """
    SELECT bucket, kalshi_count, polymarket_count, kalshi_count * polymarket_count AS comparison_count FROM counts
    WHERE bucket <> 'miscellaneous' AND kalshi_count > 0 AND polymarket_count > 0""", views={**K1, "counts": COUNTS})
def _(spark, root):
    return buckets.bucket_pairs(bucketed(spark, root))


@query("e3_bucket_effectiveness", """
    SELECT bucket, total_markets, least(kalshi_count, polymarket_count) * 2 / total_markets AS efficiency_score,
           kalshi_count * polymarket_count AS potential_comparisons, avg_confidence FROM counts""",
       r="efficiency_score avg_confidence", views={**K1, "counts": COUNTS})
def _(spark, root):
    return buckets.bucket_effectiveness(bucketed(spark, root))


@query("e3_bucket_overview", f"""
    SELECT count(*) AS active_buckets, count(*) FILTER (kalshi_count > 0 AND polymarket_count > 0) AS cross_platform_buckets,
           {len(vocab.BUCKETS)} - count(*) FILTER (bucket <> 'miscellaneous') AS empty_buckets FROM counts""",
       views={**K1, "counts": COUNTS})
def _(spark, root):
    return buckets.bucket_overview(bucketed_once(spark, root))


KEYED = f"SELECT *, {sq.keyword_bucket()} AS kb FROM markets WHERE {TRADABLE}"


@query("e10_keyword_bucket_volumes", """
    SELECT kb AS bucket, platform, count(*) AS market_count, avg(volume) AS avg_volume, sum(volume) AS total_volume
    FROM keyed GROUP BY ALL""", r="avg_volume total_volume", views={"keyed": KEYED})
def _(spark, root):
    return buckets.keyword_bucket_distribution(derived.markets(spark, root))


BLOCKED = """SELECT sum(a * b) AS o FROM (SELECT count(*) FILTER (platform = 'kalshi') AS a,
    count(*) FILTER (platform = 'polymarket') AS b FROM keyed GROUP BY kb)"""


@query("e11_reduction_report", """
    SELECT c AS current_comparisons, CAST(o AS BIGINT) AS optimized_comparisons, (1 - o / c) * 100 AS reduction_pct,
           (c - o) / 60000.0::DOUBLE AS minutes_saved, (c - o) * 0.001::DOUBLE AS cost_saved
    FROM (SELECT count(*) FILTER (platform = 'kalshi') * count(*) FILTER (platform = 'polymarket') AS c
          FROM markets WHERE is_active), blocked_total""",
       r="reduction_pct minutes_saved cost_saved", views={"keyed": KEYED, "blocked_total": BLOCKED})
def _(spark, root):
    return buckets.reduction_report(derived.markets(spark, root))


@query("d22_bucket_comparisons", """
    SELECT kb AS bucket, count(*) FILTER (platform = 'kalshi') AS kalshi_count,
           count(*) FILTER (platform = 'polymarket') AS polymarket_count,
           count(*) FILTER (platform = 'kalshi') * count(*) FILTER (platform = 'polymarket') AS comparisons
    FROM keyed GROUP BY kb""", views={"keyed": KEYED})
def _(spark, root):
    return buckets.bucket_comparisons(derived.markets(spark, root))


@query("c20_markets_in_bucket", """
    SELECT id, bucket_confidence FROM bucketed WHERE bucket = 'tech_ai' AND platform = 'kalshi'""",
       r="bucket_confidence", views=K1)
def _(spark, root):
    return buckets.in_bucket(bucketed_once(spark, root), "tech_ai", "kalshi").select("id", "bucket_confidence")


@query("c21_stale_rebucketing", f"""
    SELECT id, bucket FROM bucketed WHERE n % 4 = 0 OR open_time + to_days(2000) < {T} - to_hours(24)""", views=K1)
def _(spark, root):
    seen = derived.markets(spark, root).withColumn("bucket", F.when(F.col("n") % 4 == 0, None).otherwise("old")).withColumn(
        "processed_at", F.col("open_time") + F.make_dt_interval(F.lit(2000)))
    return buckets.rebucket_stale(seen, AS_OF).select("id", "bucket")


# --- pairs and the staged filter -------------------------------------------------------------

TOP_ORDER = """ORDER BY price_difference DESC, least(k.volume, p.volume) DESC, greatest(k.volume, p.volume) DESC,
    k.id, p.id"""


@query("d1_top_bucket_pairs", f"""
    SELECT k.id AS kalshi_id, p.id AS polymarket_id, k.title AS kalshi_title, p.title AS polymarket_title,
           k.kb AS bucket, {GAP} AS price_difference, greatest(round({GAP} - 0.02, 6), 0) AS net_gap,
           least(k.volume, p.volume) AS min_volume
    FROM keyed k JOIN keyed p USING (kb) WHERE k.platform = 'kalshi' AND p.platform = 'polymarket' AND {GAP} > 0.02
    {TOP_ORDER} LIMIT 50""", views={"keyed": KEYED})
def _(spark, root):
    df = buckets.with_keyword_bucket(derived.markets(spark, root))
    pairs = candidates.same_key_pairs(df, "bucket", 50, 0.02, 50.0, fee=0.02)
    return pairs.select("kalshi_id", "polymarket_id", "kalshi_title", "polymarket_title", "bucket",
                        "price_difference", "net_gap", "min_volume")


@query("d1_bucket_pairs_in_windows", """
    SELECT kalshi_id, polymarket_id, bucket, price_difference FROM formed
    WHERE apart <= 2592000 AND volume_ratio >= 0.1""", views=PAIR_VIEWS)
def _(spark, root):
    df = blocked(spark, root)
    sides = [staged_filter.side(df, v, ["bucket"]) for v in ("kalshi", "polymarket")]
    return staged_filter.compatible_pairs(*sides, ["bucket"]).select(
        "kalshi_id", "polymarket_id", "bucket", "price_difference")


@query("k4_staged_pairs", """
    SELECT kalshi_id, polymarket_id, bucket, price_difference, text_similarity, liquidity_score, time_alignment_score,
           arbitrage_potential FROM staged""", r="text_similarity liquidity_score time_alignment_score", views=PAIR_VIEWS)
def _(spark, root):
    return staged(spark, root).select("kalshi_id", "polymarket_id", "bucket", "price_difference", "text_similarity",
                                      "liquidity_score", "time_alignment_score", "arbitrage_potential")


def stage_counts_sql() -> str:
    v = lambda s: f"{s}.yes_price BETWEEN 0.01 AND 0.99"
    t = lambda s: f"{s}.yes_price BETWEEN 0.05 AND 0.95"
    sim = f"{sq.jaccard('k.words', 'p.words')} * 0.7"
    return f"""
    SELECT CASE WHEN NOT {v('k')} THEN '1 kalshi_invalid_price' WHEN k.volume < 100 THEN '1 kalshi_low_volume'
      WHEN NOT {v('p')} THEN '1 polymarket_invalid_price' WHEN p.volume < 100 THEN '1 polymarket_low_volume'
      WHEN NOT {t('k')} THEN '1 kalshi_price_range' WHEN NOT {t('p')} THEN '1 polymarket_price_range'
      WHEN {GAP} < 0.02 THEN '1 insufficient_arbitrage' WHEN {sim} < 0.3 AND {GAP} < 0.1 THEN '2 low_text_similarity'
      WHEN (k.liq + p.liq) / 2 < 0.1 THEN '3 low_liquidity' WHEN {RATIO} < 0.1 THEN '3 volume_imbalance'
      WHEN {APART} > 2592000 THEN '4 time_misalignment' WHEN round({GAP} - 0.01, 6) < 0.02 THEN '5 insufficient_arbitrage'
      ELSE '5 passed' END AS code, count(*) AS pairs
    FROM tok k JOIN tok p ON k.bucket = p.bucket AND k.platform = 'kalshi' AND p.platform = 'polymarket' GROUP BY 1"""


REASONS = {**PAIR_VIEWS, "reasons": stage_counts_sql()}


@query("e4_stage_reasons", """
    SELECT CAST(substring(code, 1, 1) AS BIGINT) AS step, substring(code, 3) AS reason, pairs FROM reasons""", views=REASONS)
def _(spark, root):
    return staged_filter.stage_reasons(blocked(spark, root), AS_OF).where("pairs > 0").select("step", "reason", "pairs")


@query("e5_funnel_summary", """
    SELECT s.step, coalesce(d.f, 0) AS filtered_count, i.c AS input_count, i.c - coalesce(d.f, 0) AS output_count,
           coalesce(d.f, 0) / i.c AS filter_rate, 1 - t.passed / t.total AS overall_reduction
    FROM (SELECT unnest(range(1, 6)) AS step) s
    LEFT JOIN (SELECT CAST(substring(code, 1, 1) AS BIGINT) AS step, CAST(sum(pairs) AS BIGINT) AS f FROM reasons
               WHERE code <> '5 passed' GROUP BY 1) d USING (step)
    JOIN (SELECT step, (SELECT CAST(coalesce(sum(pairs), 0) AS BIGINT) FROM reasons
          WHERE CAST(substring(code, 1, 1) AS BIGINT) >= step) AS c FROM (SELECT unnest(range(1, 6)) AS step)) i USING (step),
    (SELECT sum(pairs) FILTER (code = '5 passed') AS passed, sum(pairs) AS total FROM reasons) t""",
       r="filter_rate overall_reduction", views=REASONS)
def _(spark, root):
    reasons = staged_filter.stage_reasons(blocked(spark, root), AS_OF)
    return staged_filter.funnel_summary(reasons).select("step", "filtered_count", "input_count", "output_count",
                                                        "filter_rate", "overall_reduction")


@query("d24_incremental_pairs", """
    SELECT s.kalshi_id, s.polymarket_id, s.price_difference FROM staged s
    JOIN markets a ON a.id = s.kalshi_id JOIN markets b ON b.id = s.polymarket_id
    WHERE a.open_time >= TIMESTAMP '1995-06-01' OR b.open_time >= TIMESTAMP '1995-06-01'""", views=PAIR_VIEWS)
def _(spark, root):
    df = blocked(spark, root).withColumn("is_new", F.col("open_time") >= F.lit("1995-06-01").cast("timestamp_ntz"))
    return staged_filter.incremental_pairs(df, AS_OF).select("kalshi_id", "polymarket_id", "price_difference")


MAPPING = (("Politics", "Politics"), ("Politics", "Economics"), ("Crypto", "Technology"), ("Sports", "Entertainment"))
FREE_VIEWS = {
    "tokm": f"""SELECT *, {sq.tokens('title', vocab.JACCARD_STOP_WORDS)} AS words,
                {sq.liquidity_score('volume', 'yes_price')} AS liq FROM markets
                WHERE yes_price BETWEEN 0.05 AND 0.95 AND volume >= 100""",
}


def free_pairs_sql(on: str) -> str:
    return f"""
    SELECT k.id AS kalshi_id, p.id AS polymarket_id, {GAP} AS price_difference FROM tokm k JOIN tokm p ON {on}
    WHERE k.platform = 'kalshi' AND p.platform = 'polymarket' AND {GAP} >= 0.02
      AND ({sq.jaccard('k.words', 'p.words')} * 0.7 >= 0.3 OR {GAP} >= 0.1) AND (k.liq + p.liq) / 2 >= 0.1
      AND {RATIO} >= 0.1 AND {APART} <= 2592000 AND round({GAP} - 0.01, 6) >= 0.02"""


@query("d25_mapped_category_pairs", free_pairs_sql("(k.category, p.category) IN (" + ", ".join(
    f"('{a}', '{b}')" for a, b in MAPPING) + ")"), views=FREE_VIEWS)
def _(spark, root):
    mapping = spark.createDataFrame(list(MAPPING), "kalshi_category string, polymarket_category string")
    return staged_filter.mapped_pairs(derived.markets(spark, root), mapping, AS_OF).select(
        "kalshi_id", "polymarket_id", "price_difference")


@query("d27_cluster_pairs", free_pairs_sql("k.event_id = p.event_id"), views=FREE_VIEWS)
def _(spark, root):
    return staged_filter.filter_pairs(derived.markets(spark, root), AS_OF, keys=["event_id"], measured=False).select(
        "kalshi_id", "polymarket_id", "price_difference")


# --- text measures on pairs ------------------------------------------------------------------

SAMPLE = """SELECT e.k, e.p, a.title AS a, b.title AS b, a.title_normalized AS an, b.title_normalized AS bn
    FROM evals e JOIN markets a ON a.n = e.k JOIN markets b ON b.n = e.p"""


def title_pairs(spark: SparkSession, root: str) -> DataFrame:
    m = derived.markets(spark, root)
    side = lambda key, t: m.select(F.col("n").alias(key), F.col("title").alias(t),
                                   F.col("title_normalized").alias(f"{t}n"))
    return derived.evaluations(spark, root).join(side("k", "a"), "k").join(side("p", "b"), "p")


@query("i5_jaccard", f"SELECT k, p, {sq.jaccard('x', 'y')} AS similarity FROM (SELECT k, p, {sq.tokens('a', vocab.JACCARD_STOP_WORDS)} AS x, "
       f"{sq.tokens('b', vocab.JACCARD_STOP_WORDS)} AS y FROM pairs)", r="similarity", views={"pairs": SAMPLE})
def _(spark, root):
    return title_pairs(spark, root).select("k", "p", text.title_jaccard(F.col("a"), F.col("b")).alias("similarity"))


@query("i6_word_jaccard", f"SELECT k, p, {sq.jaccard('x', 'y')} AS similarity FROM (SELECT k, p, "
       "list_filter(list_distinct(regexp_split_to_array(lower(a), '\\W+')), lambda w: w <> '') AS x, "
       "list_filter(list_distinct(regexp_split_to_array(lower(b), '\\W+')), lambda w: w <> '') AS y FROM pairs)",
       r="similarity", views={"pairs": SAMPLE})
def _(spark, root):
    return title_pairs(spark, root).select("k", "p", text.word_jaccard(F.col("a"), F.col("b")).alias("similarity"))


@query("i7_cosine_and_i8_overlap", f"""
    SELECT k, p, CASE WHEN len(list_intersect(x, y)) = 0 THEN 0.0::DOUBLE
                 ELSE len(list_intersect(x, y)) / sqrt(len(x) * len(y)) END AS cosine,
           len(list_filter(list_intersect(x, y), lambda w: NOT list_contains({sq.ARRAY(vocab.OVERLAP_STOP_WORDS)}, w))) AS overlap
    FROM (SELECT k, p, {sq.tokens('a')} AS x, {sq.tokens('b')} AS y FROM pairs)""", r="cosine", views={"pairs": SAMPLE})
def _(spark, root):
    x, y = text.tokens(F.col("a")), text.tokens(F.col("b"))
    return title_pairs(spark, root).select("k", "p", text.set_cosine(x, y).alias("cosine"),
                                           text.overlap_count(x, y).alias("overlap"))


@query("i9_levenshtein_and_i10_containment", """
    SELECT k, p, 1.0::DOUBLE - levenshtein(an, bn) * 1.0::DOUBLE / greatest(length(an), length(bn)) AS edit_ratio,
           1.0::DOUBLE - (length(an) + length(bn) - 2 * CASE WHEN instr(an, bn) > 0 THEN length(bn)
             WHEN instr(bn, an) > 0 THEN length(an) ELSE 0 END)::DOUBLE / greatest(length(an), length(bn)) AS containment
    FROM pairs""", r="edit_ratio containment", views={"pairs": SAMPLE})
def _(spark, root):
    a, b = F.col("an"), F.col("bn")
    return title_pairs(spark, root).select("k", "p", text.levenshtein_ratio(a, b).alias("edit_ratio"),
                                           text.containment_ratio(a, b).alias("containment"))


@query("i11_text_functions", """
    SELECT n, split_part(title, ' ', 2) AS second_word, instr(title, 'resolve') AS at, length(title) AS length,
           upper(substring(title, 1, 4)) AS head FROM markets""")
def _(spark, root):
    title = F.col("title")
    return derived.markets(spark, root).select(
        "n", F.split_part(title, F.lit(" "), F.lit(2)).alias("second_word"), F.instr(title, F.lit("resolve")).alias("at"),
        F.length(title).alias("length"), F.upper(F.substring(title, 1, 4)).alias("head"))


@query("i23_volume_ratio_and_i24_net_gap", """
    SELECT e.k, e.p, CASE WHEN greatest(a.volume, b.volume) > 0 THEN least(a.volume, b.volume) / greatest(a.volume, b.volume)
           ELSE 0.0::DOUBLE END AS ratio, greatest(round(abs(a.yes_price - b.yes_price) - 0.01, 6), 0) AS net_1,
           round(abs(a.yes_price - b.yes_price) - 0.02, 6) AS net_unfloored
    FROM evals e JOIN markets a ON a.n = e.k JOIN markets b ON b.n = e.p""", r="ratio net_1 net_unfloored")
def _(spark, root):
    df = priced_pairs(spark, root)
    gap = prices.gap(F.col("ya"), F.col("yb"))
    return df.select("k", "p", prices.volume_ratio(F.col("va"), F.col("vb")).alias("ratio"),
                     prices.net_gap(gap, 0.01).alias("net_1"), prices.net_gap(gap, 0.02, floor=False).alias("net_unfloored"))


def priced_pairs(spark: SparkSession, root: str) -> DataFrame:
    m = derived.markets(spark, root)
    side = lambda key, t: m.select(F.col("n").alias(key), F.col("yes_price").alias(f"y{t}"),
                                   F.col("volume").alias(f"v{t}"), F.col("close_time").alias(f"c{t}"))
    return derived.evaluations(spark, root).select("k", "p").join(side("k", "a"), "k").join(side("p", "b"), "p")


@query("i28_close_distance", f"""
    SELECT e.k, e.p, abs(epoch(a.close_time) - epoch(b.close_time)) / 3600 AS hours,
           epoch(a.close_time) - epoch({T}) < 86400 AS first_soon, epoch(b.close_time) - epoch({T}) <= 86400 AS second_soon
    FROM evals e JOIN markets a ON a.n = e.k JOIN markets b ON b.n = e.p""", r="hours")
def _(spark, root):
    return priced_pairs(spark, root).select(
        "k", "p", dates.hours_apart(F.col("ca"), F.col("cb")).alias("hours"),
        dates.closing_soon(F.col("ca"), AS_OF, 24).alias("first_soon"),
        dates.closing_soon(F.col("cb"), AS_OF, 24, True).alias("second_soon"))


# --- scoring ---------------------------------------------------------------------------------

@query("k9_pair_features", """
    SELECT kalshi_id, polymarket_id, text_similarity AS jaccard_similarity, cosine_similarity, keyword_overlap_count,
           price_difference, volume_ratio, category_match, close_time_difference_hours, both_closing_soon,
           liquidity_score * 0.6 AS kalshi_liquidity_score, liquidity_score * 0.4 AS polymarket_liquidity_score,
           rate AS bucket_historical_success_rate, 0.7::DOUBLE AS similar_pair_confidence FROM featured""",
       r="jaccard_similarity cosine_similarity volume_ratio close_time_difference_hours kalshi_liquidity_score "
         "polymarket_liquidity_score", views=PAIR_VIEWS)
def _(spark, root):
    return scoring.with_features(staged(spark, root), AS_OF).select("kalshi_id", "polymarket_id", *scoring.FEATURES)


@query("k10_heuristic_worthiness", """
    SELECT kalshi_id, polymarket_id, worthiness, worthiness * 0.8 AS confidence_prediction FROM scored""",
       r="worthiness confidence_prediction", views=PAIR_VIEWS)
def _(spark, root):
    return scored(spark, root).select("kalshi_id", "polymarket_id", "worthiness", "confidence_prediction")


@query("k11_explanations", """
    SELECT kalshi_id, polymarket_id, CASE WHEN parts = '' THEN 'Low confidence prediction' ELSE parts END AS phrases
    FROM (SELECT *, concat_ws(', ',
      CASE WHEN text_similarity > 0.5 THEN printf('High text similarity (%.2f)', text_similarity) END,
      CASE WHEN price_difference > 0.05 THEN printf('Significant price difference (%.3f)', price_difference) END,
      CASE WHEN category_match THEN 'Categories match' END,
      CASE WHEN both_closing_soon THEN 'Both markets closing soon' END,
      CASE WHEN rate > 0.8 THEN 'High bucket success rate' END) AS parts FROM scored)""", views=PAIR_VIEWS)
def _(spark, root):
    return scored(spark, root).select("kalshi_id", "polymarket_id", scoring.explanation_phrases().alias("phrases"))


@query("c23_worthy_pairs", "SELECT kalshi_id, polymarket_id FROM scored WHERE round(worthiness, 9) >= 0.3", views=PAIR_VIEWS)
def _(spark, root):
    return scoring.worthy(scored(spark, root)).select("kalshi_id", "polymarket_id")


@query("f2_best_pairs_per_bucket", """
    SELECT kalshi_id, polymarket_id, bucket, bucket_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(worthiness, 9) DESC, kalshi_id, polymarket_id) AS bucket_rank
      FROM scored WHERE round(worthiness, 9) > 0.3) WHERE bucket_rank <= 50""", views=PAIR_VIEWS)
def _(spark, root):
    df = scored(spark, root).withColumn("worthiness", F.round("worthiness", 9))
    return staged_filter.best_per_bucket(df, "worthiness").select("kalshi_id", "polymarket_id", "bucket", "bucket_rank")


SCORE = f"""CASE WHEN k.category = p.category THEN 50 ELSE 0 END + {sq.keyword_points('k.title', 'p.title', vocab.SCORE_KEYWORDS)}
    + CASE WHEN {GAP} > 0.15 THEN 25 WHEN {GAP} > 0.1 THEN 20 WHEN {GAP} > 0.05 THEN 15 ELSE 0 END
    + CASE WHEN least(k.volume, p.volume) > 10000 THEN 15 WHEN least(k.volume, p.volume) > 1000 THEN 10
           WHEN least(k.volume, p.volume) > 100 THEN 5 ELSE 0 END"""
BOTH = "k.platform = 'kalshi' AND p.platform = 'polymarket'"


@query("d3_top_scored_pairs", f"""
    SELECT k.id AS kalshi_id, p.id AS polymarket_id, {SCORE} AS similarity_score, {GAP} AS price_difference,
           least(k.volume, p.volume) AS min_volume
    FROM (SELECT * FROM markets WHERE {TRADABLE}) k JOIN (SELECT * FROM markets WHERE {TRADABLE}) p ON {BOTH}
    WHERE {SCORE} >= 30 ORDER BY similarity_score DESC, least(k.volume, p.volume) DESC, greatest(k.volume, p.volume) DESC,
      k.id, p.id LIMIT 1000""")
def _(spark, root):
    return candidates.top_scored_pairs(derived.markets(spark, root)).select(
        "kalshi_id", "polymarket_id", "similarity_score", "price_difference", "min_volume")


@query("k16_additive_scores", f"""
    SELECT e.k, e.p, {SCORE} AS score FROM evals e JOIN markets k ON k.n = e.k JOIN markets p ON p.n = e.p""")
def _(spark, root):
    m = derived.markets(spark, root)
    k, p = candidates.renamed(m, "kalshi"), candidates.renamed(m, "polymarket")
    joined = derived.evaluations(spark, root).join(k, "kalshi_id").join(p, "polymarket_id")
    return joined.select("k", "p", scoring.additive_score(
        F.col("kalshi_title"), F.col("polymarket_title"), F.col("kalshi_category") == F.col("polymarket_category"),
        candidates.gap_column(), candidates.min_volume()).alias("score"))


RULE = f"""CASE WHEN {sq.shared_keyword('k.title', 'p.title', vocab.STRONG_PAIR_KEYWORDS)} THEN 0.85::DOUBLE
    WHEN {sq.shared_keyword('k.title', 'p.title', vocab.RELATED_PAIR_KEYWORDS)} THEN 0.6::DOUBLE
    WHEN {GAP} > 0.1 THEN 0.3::DOUBLE WHEN k.category <> 'other' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"""


@query("k17_rule_confidence", f"""
    SELECT e.k, e.p, {RULE} AS confidence, {RULE} >= 0.7 AND round({GAP} - 0.02, 6) > 0.03
           AND least(k.volume, p.volume) > 200 AS is_viable
    FROM evals e JOIN unified k ON k.n = e.k JOIN unified p ON p.n = e.p""")
def _(spark, root):
    m = derived.unified(spark, root)
    k, p = candidates.renamed(m, "kalshi"), candidates.renamed(m, "polymarket")
    joined = derived.evaluations(spark, root).join(k, "kalshi_id").join(p, "polymarket_id")
    confidence = scoring.rule_confidence(F.col("kalshi_title"), F.col("polymarket_title"), F.col("kalshi_category"),
                                         candidates.gap_column())
    viable = ((F.col("confidence") >= 0.7) & (prices.net_gap(candidates.gap_column(), 0.02) > 0.03)
              & (candidates.min_volume() > 200))
    return joined.withColumn("confidence", confidence).select("k", "p", "confidence", viable.alias("is_viable"))


# --- other pair joins ------------------------------------------------------------------------

@query("d2_edit_distance_pairs", f"""
    SELECT * FROM (SELECT k.id AS kalshi_id, p.id AS polymarket_id,
             1.0::DOUBLE - levenshtein(k.title_normalized, p.title_normalized)::DOUBLE
               / greatest(length(k.title_normalized), length(p.title_normalized)) AS title_similarity,
             {GAP} AS price_difference, {GAP} * 0.95 AS potential_profit, least(k.volume, p.volume) AS min_volume,
             least(k.liquidity, p.liquidity) AS min_liquidity
      FROM markets k JOIN markets p ON k.category = p.category AND {BOTH}
      WHERE k.is_active AND p.is_active AND least(k.volume, p.volume) > 100 AND {GAP} > 0.05)
    WHERE title_similarity > 0.7""", r="title_similarity potential_profit")
def _(spark, root):
    return candidates.edit_distance_pairs(derived.markets(spark, root))


IMPROVED = f"""
    SELECT k.id AS kalshi_id, p.id AS polymarket_id, {GAP} AS price_difference, k.category AS kalshi_category,
      CASE WHEN k.title_hash = p.title_hash THEN 1.0::DOUBLE
           WHEN length(k.title_normalized) > 5 AND length(p.title_normalized) > 5 THEN
             1.0::DOUBLE - (length(k.title_normalized) + length(p.title_normalized) - 2 * CASE
               WHEN instr(k.title_normalized, p.title_normalized) > 0 THEN length(p.title_normalized)
               WHEN instr(p.title_normalized, k.title_normalized) > 0 THEN length(k.title_normalized) ELSE 0 END)::DOUBLE
               / greatest(length(k.title_normalized), length(p.title_normalized))
           ELSE 0.0::DOUBLE END AS title_similarity,
      CASE WHEN k.category = p.category THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS category_bonus,
      CASE WHEN {sq.shared_keyword('k.title_normalized', 'p.title_normalized', vocab.BONUS_KEYWORDS)} THEN 0.3::DOUBLE
           ELSE 0.0::DOUBLE END AS keyword_bonus, least(k.volume, p.volume) AS min_volume
    FROM short k JOIN short p ON {BOTH}
    WHERE k.is_active AND p.is_active AND k.yes_price BETWEEN 0.01 AND 0.99 AND p.yes_price BETWEEN 0.01 AND 0.99
      AND {GAP} > 0.03 AND least(k.volume, p.volume) > 50"""
# Titles of unequal length, some inside others and some very short, so that every branch occurs.
SHORT = """SELECT * REPLACE (CASE WHEN n % 11 = 0 THEN event_id WHEN n % 5 = 0 THEN topic_words WHEN n % 83 = 0
             THEN 'trump' ELSE title_normalized END AS title_normalized,
             substring(CASE WHEN n % 11 = 0 THEN event_id WHEN n % 5 = 0 THEN topic_words WHEN n % 83 = 0
             THEN 'trump' ELSE title_normalized END, 1, 20) || n % 3 AS title_hash)
           FROM (SELECT *, trim(replace(replace(title_normalized, 'will', ''), 'resolve yes', '')) AS topic_words FROM markets)"""


def shortened(spark: SparkSession, root: str) -> DataFrame:
    m = derived.markets(spark, root)
    words = F.trim(F.replace(F.replace("title_normalized", F.lit("will"), F.lit("")), F.lit("resolve yes"), F.lit("")))
    n = F.col("n")
    title = (F.when(n % 11 == 0, F.col("event_id")).when(n % 5 == 0, words).when(n % 83 == 0, "trump")
             .otherwise(F.col("title_normalized")))
    return m.withColumn("title_normalized", title).withColumn(
        "title_hash", F.concat(F.substring("title_normalized", 1, 20), (n % 3).cast("string")))


@query("d4_improved_matches", """
    SELECT kalshi_id, polymarket_id, title_similarity, category_bonus, keyword_bonus, price_difference,
           round(price_difference - 0.02, 6) AS potential_profit, min_volume FROM improved
    WHERE round(title_similarity + category_bonus + keyword_bonus, 6) > 0.4""", r="title_similarity",
       views={"short": SHORT, "improved": IMPROVED})
def _(spark, root):
    return candidates.improved_matches(shortened(spark, root)).select(
        "kalshi_id", "polymarket_id", "title_similarity", "category_bonus", "keyword_bonus", "price_difference",
        "potential_profit", "min_volume")


def top_gap_sql(condition: str, k: int, source: str = "markets") -> str:
    return f"""
    SELECT k.id AS kalshi_id, p.id AS polymarket_id, {GAP} AS price_difference, least(k.volume, p.volume) AS min_volume
    FROM {source} k JOIN {source} p ON {BOTH} WHERE {condition} {TOP_ORDER} LIMIT {k}"""


@query("d5_category_or_keyword_pairs", top_gap_sql(
    f"k.is_active AND p.is_active AND k.volume > 1000 AND p.volume > 1000 AND {GAP} > 0.05 AND (k.category = p.category "
    f"OR {sq.shared_keyword('k.title', 'p.title', vocab.CANDIDATE_KEYWORDS)})", 25))
def _(spark, root):
    return candidates.category_or_keyword_pairs(derived.markets(spark, root)).select(
        "kalshi_id", "polymarket_id", "price_difference", "min_volume")


def toplist_sql(venue: str, limit: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY volume DESC, id) AS category_rank
        FROM markets WHERE platform = '{venue}' AND {TRADABLE}) WHERE category_rank <= {-(-limit // 8)}
        ORDER BY volume DESC, id LIMIT {limit})"""


@query("d6_toplist_pairs", f"""
    SELECT k.id AS kalshi_id, p.id AS polymarket_id, {GAP} AS price_difference, least(k.volume, p.volume) AS min_volume
    FROM {toplist_sql('kalshi', 200)} k JOIN {toplist_sql('polymarket', 300)} p ON k.category = p.category
      OR {sq.shared_keyword('k.title', 'p.title', vocab.TOPLIST_KEYWORDS)} OR {GAP} > 0.1
    ORDER BY min_volume DESC, k.id, p.id LIMIT 200""")
def _(spark, root):
    return candidates.toplist_pairs(derived.markets(spark, root)).select(
        "kalshi_id", "polymarket_id", "price_difference", "min_volume")


@query("f1_diversified_top_markets", f"SELECT id, category, volume, category_rank FROM {toplist_sql('polymarket', 300)} t")
def _(spark, root):
    return candidates.diversified_top(derived.markets(spark, root), "polymarket", 300).select(
        "id", "category", "volume", "category_rank")


@query("d7_same_category_top_pairs", top_gap_sql(
    f"k.is_active AND p.is_active AND k.category = p.category AND k.volume > 500 AND p.volume > 500 AND {GAP} > 0.05", 10))
def _(spark, root):
    return candidates.same_key_pairs(derived.markets(spark, root), "category", 10, 0.05, 500.0).select(
        "kalshi_id", "polymarket_id", "price_difference", "min_volume")


@query("d8_first_word_matches", top_gap_sql(
    f"lower(k.title_normalized) LIKE '%' || lower(split_part(p.title_normalized, ' ', 1)) || '%' AND {GAP} > 0.1", 5, "short"),
       views={"short": SHORT})
def _(spark, root):
    m = shortened(spark, root).withColumn("title", F.col("title_normalized"))
    return candidates.first_word_matches(m).select("kalshi_id", "polymarket_id", "price_difference", "min_volume")


@query("d19_similar_within_category", f"""
    SELECT a.category, a.id AS market1_id, b.id AS market2_id, {sq.jaccard('a.w', 'b.w')} AS similarity
    FROM word_sets a JOIN word_sets b ON a.category = b.category AND a.id < b.id
    WHERE len(a.w) > 0 AND {sq.jaccard('a.w', 'b.w')} >= 0.7 - 1e-9""", r="similarity",
       views={"word_sets": f"SELECT id, category, {sq.tokens('title', vocab.JACCARD_STOP_WORDS)} AS w FROM markets"})
def _(spark, root):
    return candidates.similar_within_category(derived.markets(spark, root))


@query("d19_selected_pairs", """
    SELECT a.id AS market1_id, b.id AS market2_id FROM markets a JOIN markets b ON a.id < b.id
    WHERE a.volume > 12000 AND b.volume > 12000""")
def _(spark, root):
    m = derived.markets(spark, root)
    return candidates.selected_pairs(m, m.where("volume > 12000").select("id")).select("market1_id", "market2_id")


@query("d26_embedding_pairs", """
    SELECT a.label, a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.v, b.v) AS similarity
    FROM mixed a JOIN mixed b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.7""",
       r="similarity", views={"mixed": """
    SELECT v.vec_id, b.label, list_transform(list_zip(b.embedding, v.embedding), lambda z: z[1]::DOUBLE + 0.5::DOUBLE * z[2]::DOUBLE) AS v
    FROM embeddings v JOIN embeddings b ON b.vec_id = v.vec_id - v.vec_id % 5"""})
def _(spark, root):
    return candidates.embedding_pairs(derived.mixed_vectors(spark, root))


@query("d28_comparison_counts", """
    SELECT a AS kalshi_count, b AS polymarket_count, a * b AS total_comparisons, a * b / 60000.0::DOUBLE AS minutes,
           a * b * 0.001::DOUBLE AS cost_usd
    FROM (SELECT count(*) FILTER (platform = 'kalshi') AS a, count(*) FILTER (platform = 'polymarket') AS b
          FROM markets WHERE is_active)""", r="minutes cost_usd")
def _(spark, root):
    return candidates.comparison_count(derived.markets(spark, root))


@query("e13_context_budget", """
    SELECT a * b AS total_comparisons, a * b * 500 AS total_chars, CAST(ceil(a * b * 500 / 4000000) AS BIGINT) AS calls_needed
    FROM (SELECT count(*) FILTER (platform = 'kalshi') AS a, count(*) FILTER (platform = 'polymarket') AS b
          FROM markets WHERE is_active)""")
def _(spark, root):
    return candidates.context_budget(derived.markets(spark, root))


PREFILTER = f"""CASE WHEN k.category = p.category THEN 50 ELSE 0 END
    + {sq.keyword_points('k.title', 'p.title', vocab.PREFILTER_KEYWORDS)}
    + CASE WHEN {GAP} > 0.1 THEN 20 WHEN {GAP} > 0.05 THEN 10 ELSE 0 END"""


@query("e12_prefilter_counts", f"""
    SELECT count(*) AS total_pairs, count(*) FILTER (s >= 30) AS filtered_pairs, count(*) FILTER (s >= 50) AS high_quality_pairs
    FROM (SELECT {PREFILTER} AS s FROM markets k JOIN markets p ON {BOTH}
          WHERE k.is_active AND p.is_active AND k.volume > 100 AND p.volume > 100)""")
def _(spark, root):
    return candidates.prefilter_counts(derived.markets(spark, root))


@query("h4_token_set_algebra", f"""
    SELECT k, p, len(list_intersect(x, y)) AS shared, len(x) + len(y) - len(list_intersect(x, y)) AS either,
           len(list_filter(x, lambda w: NOT list_contains(y, w))) AS only_left
    FROM (SELECT k, p, {sq.tokens('a')} AS x, {sq.tokens('b')} AS y FROM pairs)""", views={"pairs": SAMPLE})
def _(spark, root):
    x, y = text.tokens(F.col("a")), text.tokens(F.col("b"))
    return title_pairs(spark, root).select(
        "k", "p", F.size(F.array_intersect(x, y)).alias("shared"), F.size(F.array_union(x, y)).alias("either"),
        F.size(F.array_except(x, y)).alias("only_left"))
