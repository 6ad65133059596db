"""Registered queries: evaluations, arbitrage economics, groups and the full funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.config import ArbitrageConfig, ModelConfig
from crossmarket.functions import prices, replies, text, vocab
from crossmarket.operators import arbitrage, browse, buckets, evaluate, groups, model, reports, scoring, staged_filter
from crossmarket.plans import sqltext as sq
from crossmarket.plans.oracle_views import T
from crossmarket.plans.pairing import PAIR_VIEWS, blocked, scored
from crossmarket.plans.registry import query
from crossmarket.sources import derived, sinks
from crossmarket.sources.checkpoints import cut
from crossmarket.sources.derived import AS_OF

GAP = "round(abs(k.yes_price - p.yes_price), 6)"
DETAIL = f"""SELECT e.*, k.title AS kalshi_title, p.title AS polymarket_title, k.category AS kalshi_category,
    p.category AS polymarket_category, k.yes_price AS kalshi_price, p.yes_price AS polymarket_price,
    k.volume AS kalshi_volume, p.volume AS polymarket_volume, k.close_time AS kalshi_close, p.close_time AS polymarket_close,
    k.liquidity AS kalshi_liquidity, p.liquidity AS polymarket_liquidity,
    {GAP} AS price_difference, least(k.volume, p.volume) AS min_volume
    FROM evals e JOIN markets k ON k.n = e.k JOIN markets p ON p.n = e.p"""
VIEWS = {"detail": DETAIL}


def detailed(spark: SparkSession, root: str) -> DataFrame:
    """Evaluations with both listings, gap and smaller volume."""
    df = evaluate.with_both_markets(derived.evaluations(spark, root), derived.markets(spark, root),
                                    ("title", "category", "yes_price", "volume", "liquidity", "close_time"))
    df = df.withColumnRenamed("kalshi_yes_price", "kalshi_price").withColumnRenamed("polymarket_yes_price", "polymarket_price")
    return df.withColumn("price_difference", prices.gap(F.col("kalshi_price"), F.col("polymarket_price"))).withColumn(
        "min_volume", F.least("kalshi_volume", "polymarket_volume"))


def opportunities(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.evaluated_opportunities(derived.evaluations(spark, root), derived.markets(spark, root))


OPPS = {**VIEWS, "opps": """SELECT *, greatest(round(price_difference - 0.02, 6), 0) AS potential_profit,
    greatest(round(price_difference - 0.02, 6), 0) * log10(min_volume + 1) / 10 AS risk_adjusted_score
    FROM detail WHERE confidence_score >= 0.7 AND price_difference > 0.03 AND min_volume > 100"""}


@query("d9_evaluated_opportunities", """SELECT kalshi_id, polymarket_id, confidence_score, price_difference,
    potential_profit, min_volume, risk_adjusted_score FROM opps""", r="risk_adjusted_score", views=OPPS)
def _(spark, root):
    return opportunities(spark, root).select("kalshi_id", "polymarket_id", "confidence_score", "price_difference",
                                             "potential_profit", "min_volume", "risk_adjusted_score")


@query("d10_strict_opportunities", """
    SELECT kalshi_id, polymarket_id, greatest(round(price_difference - 0.025, 6), 0) AS potential_profit,
           greatest(round(price_difference - 0.025, 6), 0) * confidence_score * log10(min_volume + 1) / 15 AS risk_adjusted_score
    FROM detail WHERE confidence_score >= 0.75 AND price_difference > 0.04 AND min_volume > 500""",
       r="risk_adjusted_score", views=VIEWS)
def _(spark, root):
    return evaluate.evaluated_opportunities(
        derived.evaluations(spark, root), derived.markets(spark, root), fee=0.025, min_gap=0.04, min_volume=500.0,
        divisor=15.0, confidence_weight=True, threshold=0.75).select(
        "kalshi_id", "polymarket_id", "potential_profit", "risk_adjusted_score")


@query("d11_evaluation_details", """
    SELECT e.kalshi_id, e.polymarket_id, coalesce(d.kalshi_price, 0) AS kalshi_price, coalesce(d.price_difference, 0)
           AS price_difference, coalesce(d.min_volume, 0) AS min_volume
    FROM evals e LEFT JOIN (SELECT detail.* FROM detail WHERE kalshi_volume > 0) d USING (kalshi_id, polymarket_id)""", views=VIEWS)
def _(spark, root):
    known = derived.markets(spark, root).where((F.col("platform") != "kalshi") | (F.col("volume") > 0))
    return evaluate.evaluation_details(derived.evaluations(spark, root), known).select(
        "kalshi_id", "polymarket_id", "kalshi_price", "price_difference", "min_volume")


@query("d12_evaluated_listing", """
    SELECT kalshi_id, kalshi_title, polymarket_id, polymarket_title, confidence_score, is_equivalent FROM detail""", views=VIEWS)
def _(spark, root):
    return detailed(spark, root).select("kalshi_id", "kalshi_title", "polymarket_id", "polymarket_title",
                                        "confidence_score", "is_equivalent")


@query("c22_confidence_gates", """
    SELECT count(*) AS evaluated, count(*) FILTER (confidence_score >= 0.3) AS screened,
           count(*) FILTER (confidence_score >= 0.7) AS equivalent, count(*) FILTER (confidence_score >= 0.75) AS accepted,
           count(*) FILTER (confidence_score >= 0.9) AS high_confidence FROM evals""")
def _(spark, root):
    return evaluate.confidence_gates(derived.evaluations(spark, root))


@query("c17_similar_above", """
    SELECT kalshi_id, polymarket_id, confidence_score FROM evals WHERE confidence_score >= 0.7
    ORDER BY confidence_score DESC, kalshi_id, polymarket_id LIMIT 100""")
def _(spark, root):
    return browse.similar_above(derived.evaluations(spark, root)).select("kalshi_id", "polymarket_id", "confidence_score")


# --- prompts and replies ---------------------------------------------------------------------

def confident_first() -> list:
    return [F.desc("confidence_score"), F.asc("kalshi_id"), F.asc("polymarket_id")]


NUMBERED = """SELECT *, (rn - 1) // 10 AS batch_id, (rn - 1) % 10 + 1 AS position FROM (
    SELECT *, row_number() OVER (ORDER BY confidence_score DESC, kalshi_id, polymarket_id) AS rn FROM detail)"""
BATCHES = {**VIEWS, "numbered": NUMBERED}


def batched(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.numbered(detailed(spark, root), confident_first(), 10)


@query("f10_batch_numbers", "SELECT kalshi_id, polymarket_id, batch_id, position FROM numbered", views=BATCHES)
def _(spark, root):
    return batched(spark, root).select("kalshi_id", "polymarket_id", "batch_id", "position")


SCORE100 = "CAST(round(confidence_score * 100) AS BIGINT)"


@query("f11_adaptive_batches", """
    SELECT tier, count(DISTINCT batch_id) AS batches, count(*) AS pairs FROM (
      SELECT tier, (row_number() OVER (PARTITION BY tier ORDER BY s DESC, kalshi_id, polymarket_id) - 1)
             // CASE tier WHEN 'high' THEN 3 WHEN 'medium' THEN 10 ELSE 20 END AS batch_id
      FROM (SELECT *, round(confidence_score * 130, 6) AS s, CASE WHEN round(confidence_score * 130, 6) >= 100 THEN 'high'
              WHEN round(confidence_score * 130, 6) >= 60 THEN 'medium' ELSE 'low' END AS tier FROM evals)) GROUP BY tier""")
def _(spark, root):
    df = derived.evaluations(spark, root).withColumn("s", F.round(F.col("confidence_score") * 130, 6))
    done = evaluate.adaptive_batches(df, "s", [F.desc("s"), F.asc("kalshi_id"), F.asc("polymarket_id")])
    return done.groupBy("tier").agg(F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("pairs"))


def entry_sql() -> str:
    line = lambda v, tag: f"'{tag}: ' || {v}_title || ' | ' || {v}_category || ' | ' || printf('%.3f', {v}_price)"
    return (f"'PAIR ' || position || chr(10) || {line('kalshi', 'KALSHI')} || chr(10) || {line('polymarket', 'POLYMARKET')}"
            " || chr(10) || 'gap ' || printf('%.3f', abs(kalshi_price - polymarket_price))")


@query("b23_screening_prompts", f"""
    SELECT batch_id, count(*) AS pairs, '{evaluate.INSTRUCTIONS['screening']}' || chr(10) || chr(10)
           || string_agg({entry_sql()}, chr(10) || chr(10) ORDER BY position) || chr(10) || chr(10)
           || '{evaluate.ANSWER_FORMAT}' AS prompt FROM numbered GROUP BY batch_id""", views=BATCHES)
def _(spark, root):
    return evaluate.batch_prompts(batched(spark, root), "screening")


def json_replies(df: DataFrame) -> DataFrame:
    """Reply texts: prose around JSON, some without JSON, some with missing fields."""
    body = F.to_json(F.struct("confidence_score", "reasoning", F.col("confidence_score").alias("semantic_similarity"),
                              F.when(F.col("k") % 10 != 0, F.lit("PROCEED")).alias("recommended_action")))
    return df.withColumn("reply", F.when(F.col("p") % 7 == 0, F.lit("no structured answer")).otherwise(
        F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))))


JSON_REPLIES = """
    SELECT kalshi_id, polymarket_id, CASE WHEN p % 7 = 0 THEN 0.5 ELSE confidence_score END AS confidence_score,
           CASE WHEN p % 7 = 0 THEN 'no structured answer' ELSE reasoning END AS reasoning,
           CASE WHEN p % 7 = 0 THEN 0.5 ELSE 0.0 END AS arbitrage_viability,
           CASE WHEN p % 7 = 0 THEN 'INVESTIGATE' WHEN k % 10 <> 0 THEN 'PROCEED' ELSE 'REJECT' END AS recommended_action
    FROM evals"""


@query("b24_json_replies", JSON_REPLIES)
def _(spark, root):
    df = json_replies(derived.evaluations(spark, root)).select("kalshi_id", "polymarket_id", replies.json_reply(
        F.col("reply")).alias("r"))
    return df.select("kalshi_id", "polymarket_id", "r.confidence_score", "r.reasoning", "r.arbitrage_viability",
                     "r.recommended_action")


@query("m4_table_evaluator", JSON_REPLIES)
def _(spark, root):
    """The evaluator seam with its default: replies from a table by pair hash."""
    keyed = json_replies(detailed(spark, root)).withColumn("pair_hash", evaluate.hash_of_pair())
    judged = evaluate.evaluate_pairs(keyed.select("kalshi_id", "polymarket_id", "pair_hash"),
                                     evaluate.table_evaluator(keyed.select("pair_hash", "reply")))
    return judged.select("kalshi_id", "polymarket_id", "confidence_score", "reasoning", "arbitrage_viability", "recommended_action")


@query("b23_pair_prompts", """
    SELECT kalshi_id, polymarket_id, concat_ws(chr(10), 'kalshi: ' || kalshi_title, 'polymarket: ' || polymarket_title,
             'gap: ' || printf('%.3f', price_difference), 'prices: ' || printf('%.3f / %.3f', kalshi_price, polymarket_price),
             'categories: ' || kalshi_category || ' / ' || polymarket_category,
             'similarity: ' || printf('%.2f', round(CAST(text_similarity AS DECIMAL(18,9)), 2)::DOUBLE),
             'closes: ' || strftime(kalshi_close_time, '%Y-%m-%d') || ' / ' || strftime(polymarket_close_time, '%Y-%m-%d'),
             'score: ' || printf('%.3f', round(CAST(worthiness AS DECIMAL(18,9)), 3)::DOUBLE),
             'Answer as JSON with confidence_score, reasoning, semantic_similarity, arbitrage_viability, risk_assessment, recommended_action')
           AS prompt FROM scored WHERE round(worthiness, 9) >= 0.6""", views=PAIR_VIEWS)
def _(spark, root):
    worthy = scored(spark, root).where(F.col("worthiness") >= prices.least_rounding_to(0.6, 9))
    return worthy.select("kalshi_id", "polymarket_id", evaluate.pair_prompt().alias("prompt"))


@query("b25_line_replies", """
    SELECT kalshi_id, polymarket_id, confidence_score, 'line ' || position AS reasoning, confidence_score >= 0.7 AS is_equivalent
    FROM numbered WHERE position <= 8""", views=BATCHES)
def _(spark, root):
    df = batched(spark, root)
    line = F.format_string('PAIR %d: confidence=%s, reasoning="line %d"', F.col("position"),
                           F.col("confidence_score").cast("string"), F.col("position"))
    text = df.where(F.col("position") <= 8).groupBy("batch_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    table = text.select("batch_id", F.concat(F.lit("Results:\n"), "body", F.lit("\nend")).alias("reply"))
    pairs = df.select("batch_id", "position", "kalshi_id", "polymarket_id")
    return evaluate.parse_line_replies(pairs, table).select("kalshi_id", "polymarket_id", "confidence_score",
                                                            "reasoning", "is_equivalent")


@query("b26_fallback_evaluations", """
    SELECT s.kalshi_id, s.polymarket_id, coalesce(e.confidence_score, 0) AS confidence_score,
           CASE WHEN e.k IS NULL THEN 'fallback' ELSE 'table' END AS provider_used,
           coalesce(e.confidence_score, s.text_similarity) AS semantic_similarity
    FROM staged s LEFT JOIN evals e ON e.kalshi_id = s.kalshi_id AND e.polymarket_id = s.polymarket_id""",
       r="semantic_similarity", views=PAIR_VIEWS)
def _(spark, root):
    parsed = derived.evaluations(spark, root).select(
        "kalshi_id", "polymarket_id", "confidence_score", "reasoning", F.col("confidence_score").alias("semantic_similarity"),
        F.lit(None).cast("double").alias("arbitrage_viability"), F.lit(None).cast("string").alias("risk_assessment"),
        F.lit(None).cast("string").alias("recommended_action"))
    return evaluate.staged_with_fallback(blocked(spark, root), parsed, AS_OF).select(
        "kalshi_id", "polymarket_id", "confidence_score", "provider_used", "semantic_similarity")


@query("d21_cache_lookup", f"""
    SELECT CASE WHEN evaluated_at >= {T} - to_hours(24) THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS pairs
    FROM evals GROUP BY 1""")
def _(spark, root):
    df = detailed(spark, root)
    pairs = df.select("kalshi_id", "polymarket_id", "kalshi_title", "polymarket_title")
    cache = df.select(evaluate.hash_of_pair().alias("pair_hash"), F.col("evaluated_at").alias("cached_at"))
    hits, misses = evaluate.cache_lookup(pairs, cache, AS_OF)
    both = hits.select(F.lit("hit").alias("outcome")).unionByName(misses.select(F.lit("miss").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("pairs"))


# --- economics -------------------------------------------------------------------------------

ECON = {
    **VIEWS,
    "sized": """SELECT *, price_difference AS g, confidence_score AS sem,
        abs(epoch(kalshi_close) - epoch(polymarket_close)) AS apart,
        CASE WHEN price_difference > 0 THEN round(CAST(least(min_volume * 0.2, 10000, greatest(0.0::DOUBLE, least(0.25::DOUBLE,
          (price_difference * 0.8 - (1 - 0.8::DOUBLE)) / price_difference)) * 10000) AS DECIMAL(28,8)), 2)::DOUBLE END AS size
        FROM detail""",
    "costed": """SELECT *, size * 0.01 + size * 0.02 + 5.0 + size * (
          least(0.01::DOUBLE, size / nullif(kalshi_volume, 0) * 0.5) + least(0.01::DOUBLE, size / nullif(polymarket_volume, 0) * 0.5))
          AS total_cost,
        CASE WHEN min_volume > 10000 THEN 0.1 WHEN min_volume > 5000 THEN 0.2 WHEN min_volume > 1000 THEN 0.4
             WHEN min_volume > 500 THEN 0.6 ELSE 0.8 END::DOUBLE AS liq_risk,
        CASE WHEN apart / 3600 < 1 THEN 0.1 WHEN apart / 3600 < 24 THEN 0.2 WHEN apart / 3600 < 168 THEN 0.4 ELSE 0.7 END::DOUBLE AS time_risk,
        CASE WHEN g < 0.02 THEN 0.3 WHEN g > 0.2 THEN 0.4 ELSE 0.2 END::DOUBLE AS exec_risk FROM sized""",
    "risked": """SELECT *, round(liq_risk * 0.3 + time_risk * 0.25 + exec_risk * 0.2 + (1 - sem) * 0.15 + 0.01, 6) AS risk_score,
        round(g * size - total_cost, 6) AS profit FROM costed""",
    "measured": f"""SELECT *, CASE WHEN risk_score < 0.15 THEN 'very_low' WHEN risk_score < 0.3 THEN 'low' WHEN risk_score < 0.5
          THEN 'medium' WHEN risk_score < 0.7 THEN 'high' ELSE 'very_high' END AS risk_level,
        CASE WHEN size > 0 THEN round(profit / size, 6) ELSE 0.0::DOUBLE END AS share,
        (epoch(least(kalshi_close, polymarket_close)) - epoch({T})) / 86400 AS days FROM risked""",
    "economy": """SELECT *, CASE WHEN days > 0 THEN round(share * 365 / greatest(1, days), 6) ELSE 0.0::DOUBLE END AS roi,
        greatest(0.5::DOUBLE, 1 - risk_score) AS success FROM measured""",
    "found": f"""SELECT *, round(least(1.0::DOUBLE, share / 0.1) * 0.4 + least(1.0::DOUBLE, roi / 100) * 0.3
          + (1 - risk_score) * 0.2 + success * 0.1, 3) AS priority,
        least(kalshi_close, polymarket_close, {T} + to_hours(24)) AS expires_at FROM economy
        WHERE confidence_score >= 0.75 AND profit >= 50 AND share >= 0.02 AND risk_level IN ('very_low', 'low', 'medium')""",
}


def evaluated(spark: SparkSession, root: str) -> DataFrame:
    df = detailed(spark, root).withColumn("semantic_similarity", F.col("confidence_score"))
    return df.withColumnRenamed("kalshi_close", "kalshi_close_time").withColumnRenamed("polymarket_close", "polymarket_close_time")


def analyzed(spark: SparkSession, root: str) -> DataFrame:
    return arbitrage.analyze(evaluated(spark, root), AS_OF)


@query("k18_arbitrage_types", """
    SELECT kalshi_id, polymarket_id, CASE WHEN g >= 0.05 THEN 'simple_arbitrage' WHEN apart > 86400 THEN 'temporal_arbitrage'
           WHEN CASE WHEN greatest(kalshi_volume, polymarket_volume) > 0 THEN min_volume / greatest(kalshi_volume, polymarket_volume)
                ELSE 0 END < 0.3 THEN 'liquidity_arbitrage' ELSE 'cross_platform' END AS arbitrage_type,
           CASE WHEN kalshi_price < polymarket_price THEN 'kalshi' ELSE 'polymarket' END AS buy_platform,
           least(kalshi_price, polymarket_price) AS buy_price FROM sized""", views=ECON)
def _(spark, root):
    return evaluated(spark, root).select(
        "kalshi_id", "polymarket_id", arbitrage.arbitrage_type().alias("arbitrage_type"),
        arbitrage.strategy()["buy_platform"].alias("buy_platform"), arbitrage.strategy()["buy_price"].alias("buy_price"))


@query("k20_position_sizes_and_k21_costs", """
    SELECT kalshi_id, polymarket_id, size AS position_size, total_cost, total_cost / nullif(size, 0) AS cost_percentage FROM costed""",
       r="total_cost cost_percentage", views=ECON)
def _(spark, root):
    return analyzed(spark, root).select("kalshi_id", "polymarket_id", "position_size", "transaction_costs.total_cost",
                                        "transaction_costs.cost_percentage")


@query("k22_risk", """
    SELECT kalshi_id, polymarket_id, risk_score, risk_level,
           (liq_risk > 0.3)::INT + (time_risk > 0.3)::INT + (round(1 - sem, 9) > 0.2)::INT + (exec_risk > 0.3)::INT AS risks,
           2 + (liq_risk > 0.3)::INT + (time_risk > 0.3)::INT AS mitigations FROM measured""", views=ECON)
def _(spark, root):
    df = evaluated(spark, root).withColumn("semantic_similarity", F.round("semantic_similarity", 9))
    return arbitrage.with_risk(df, ArbitrageConfig()).select(
        "kalshi_id", "polymarket_id", "risk_score", "risk_level", F.size(F.filter("primary_risks", lambda r: r.isNotNull())).alias("risks"),
        F.size("mitigation_strategies").alias("mitigations"))


@query("k23_metrics", """
    SELECT kalshi_id, polymarket_id, profit AS expected_profit_usd, share AS expected_profit_percentage, roi AS roi_percentage,
           success AS success_probability, greatest(30, CAST(floor(round(exec_risk * 120, 6)) AS BIGINT)) AS execution_minutes
    FROM economy""", r="success_probability", views=ECON)
def _(spark, root):
    return analyzed(spark, root).select("kalshi_id", "polymarket_id", "expected_profit_usd", "expected_profit_percentage",
                                        "roi_percentage", "success_probability", "execution_minutes")


@query("k26_detected_opportunities", """
    SELECT kalshi_id, polymarket_id, profit AS expected_profit_usd, share AS expected_profit_percentage, risk_level,
           priority AS priority_score, expires_at FROM found""", r="priority_score", views=ECON)
def _(spark, root):
    return arbitrage.detect(evaluated(spark, root), AS_OF).select(
        "kalshi_id", "polymarket_id", "expected_profit_usd", "expected_profit_percentage", "risk_level", "priority_score",
        "expires_at")


@query("c24_profitable_literal_gate", """
    SELECT kalshi_id, polymarket_id, risk_level FROM economy WHERE profit >= 50 AND share >= 0.02 AND risk_level <= 'medium'""",
       views=ECON)
def _(spark, root):
    cfg = ArbitrageConfig(risk_gate="literal")
    return arbitrage.profitable(analyzed(spark, root), cfg).select("kalshi_id", "polymarket_id", "risk_level")


@query("g2_ranked_opportunities", """
    SELECT kalshi_id, polymarket_id, priority AS priority_score FROM found ORDER BY priority DESC, kalshi_id, polymarket_id LIMIT 10""",
       views=ECON)
def _(spark, root):
    return arbitrage.ranked(arbitrage.detect(evaluated(spark, root), AS_OF), 10).select("kalshi_id", "polymarket_id", "priority_score")


@query("g3_top_margins", """
    SELECT kalshi_id, polymarket_id, share FROM found ORDER BY share DESC, kalshi_id, polymarket_id LIMIT 50""", views=ECON)
def _(spark, root):
    return arbitrage.detect(evaluated(spark, root), AS_OF).orderBy(
        F.desc("expected_profit_percentage"), "kalshi_id", "polymarket_id").limit(50).select(
        "kalshi_id", "polymarket_id", F.col("expected_profit_percentage").alias("share"))


@query("e8_performance_summary", """
    SELECT count(*) AS total_opportunities, sum(profit) AS total_potential_profit, avg(share) AS avg_profit_percentage,
           avg(roi) AS avg_roi_percentage, avg(risk_score) AS avg_risk_score, count(*) FILTER (risk_level = 'medium') AS risk_medium,
           count(*) FILTER (risk_level = 'low') AS risk_low FROM found""",
       r="total_potential_profit avg_profit_percentage avg_roi_percentage avg_risk_score", views=ECON)
def _(spark, root):
    return arbitrage.performance_summary(arbitrage.detect(evaluated(spark, root), AS_OF)).drop(
        "top_opportunity", "risk_very_low", "risk_high", "risk_very_high")


@query("c19_by_risk_level", "SELECT kalshi_id, polymarket_id FROM found WHERE risk_level = 'low'", views=ECON)
def _(spark, root):
    return arbitrage.detect(evaluated(spark, root), AS_OF).where(F.col("risk_level") == "low").select("kalshi_id", "polymarket_id")


@query("c15_live_opportunities", f"""
    SELECT kalshi_id, polymarket_id, priority AS priority_score FROM found WHERE expires_at > {T}
    ORDER BY priority DESC, profit DESC, 'arb_' || kalshi_id || '_' || polymarket_id LIMIT 50""", views=ECON)
def _(spark, root):
    return browse.live_opportunities(arbitrage.detect(evaluated(spark, root), AS_OF), AS_OF).select(
        "kalshi_id", "polymarket_id", "priority_score")


@query("a8_opportunity_rows", """
    SELECT 'arb_' || kalshi_id || '_' || polymarket_id AS opportunity_id, least(kalshi_price, polymarket_price) AS buy_price,
           round(profit, 4) AS expected_profit_usd, 'detected' AS status FROM found""", r="expected_profit_usd", views=ECON)
def _(spark, root):
    rows = sinks.opportunity_rows(arbitrage.detect(evaluated(spark, root), AS_OF))
    return rows.select("opportunity_id", F.get_json_object("strategy", "$.buy_price").cast("double").alias("buy_price"),
                       "expected_profit_usd", "status")


@query("b27_contract_projection", """
    SELECT 'arb_' || kalshi_id || '_' || polymarket_id AS id, CASE WHEN kalshi_price < polymarket_price THEN kalshi_id
           ELSE polymarket_id END AS buy_id, greatest(kalshi_price, polymarket_price) AS sell_price, share AS margin,
           size AS max_investment, round(share * 1000, 6) AS estimated_return FROM found""",
       r="estimated_return", views=ECON)
def _(spark, root):
    rows = arbitrage.contract_view(arbitrage.detect(evaluated(spark, root), AS_OF))
    return rows.select("id", F.col("buyMarket.externalId").alias("buy_id"), F.col("sellMarket.price").alias("sell_price"),
                       F.col("profitMargin").alias("margin"), F.col("maxInvestment").alias("max_investment"),
                       F.col("estimatedReturn").alias("estimated_return"))


def marked(spark: SparkSession, root: str) -> DataFrame:
    """Stored opportunities: margins, venues, categories and states."""
    df = opportunities(spark, root)
    cheap = F.col("kalshi_yes_price") < F.col("polymarket_yes_price")
    side = lambda a, b: F.when(cheap, a).otherwise(b)
    number = lambda c: F.regexp_replace(c, "^[a-z]+-", "")
    return df.select(
        F.concat_ws("_", "kalshi_id", "polymarket_id").alias("opportunity_id"), "kalshi_id", "polymarket_id",
        "confidence_score", F.col("potential_profit").alias("profit_margin"), F.col("kalshi_category").alias("category"),
        side(F.lit("kalshi"), F.lit("polymarket")).alias("buy_platform"), side(F.lit("polymarket"), F.lit("kalshi")).alias("sell_platform"),
        side(number("kalshi_id"), number("polymarket_id")).alias("buy_external_id"),
        side(number("polymarket_id"), number("kalshi_id")).alias("sell_external_id"),
        F.when(F.col("p") % 5 == 0, "closed").otherwise("active").alias("status"))


MARKED = {**OPPS, "marked": """SELECT *, kalshi_id || '_' || polymarket_id AS opportunity_id, potential_profit AS profit_margin,
    CASE WHEN p % 5 = 0 THEN 'closed' ELSE 'active' END AS status,
    CASE WHEN kalshi_price < polymarket_price THEN 'kalshi' ELSE 'polymarket' END AS buy_platform FROM opps"""}


@query("c16_top_margin_opportunities", """
    SELECT opportunity_id, profit_margin FROM marked WHERE status = 'active' AND profit_margin >= 0.02
    ORDER BY profit_margin DESC, opportunity_id LIMIT 50""", views=MARKED)
def _(spark, root):
    return browse.top_margins(marked(spark, root)).select("opportunity_id", "profit_margin")


@query("c18_contract_query", """
    SELECT opportunity_id, confidence_score FROM marked WHERE profit_margin >= 0.1 AND confidence_score >= 0.8
      AND kalshi_category IN ('Crypto', 'Sports') ORDER BY confidence_score, opportunity_id LIMIT 50""", views=MARKED)
def _(spark, root):
    return browse.contract_query(marked(spark, root), min_profit=0.1, min_confidence=0.8, categories=["Crypto", "Sports"],
                                 sort="confidence_score", descending=False).select("opportunity_id", "confidence_score")


@query("d17_both_sides", """
    SELECT opportunity_id, CASE buy_platform WHEN 'kalshi' THEN kalshi_title ELSE polymarket_title END AS buy_title,
           CASE buy_platform WHEN 'kalshi' THEN polymarket_title ELSE kalshi_title END AS sell_title FROM marked""", views=MARKED)
def _(spark, root):
    return browse.with_both_sides(marked(spark, root), derived.markets(spark, root)).select("opportunity_id", "buy_title", "sell_title")


@query("j3_replace_active", """
    SELECT opportunity_id, status, profit_margin FROM marked WHERE status <> 'active'
    UNION ALL SELECT opportunity_id, 'active', profit_margin + 0.01 FROM marked WHERE confidence_score >= 0.9""",
       r="profit_margin", views=MARKED)
def _(spark, root):
    from crossmarket.operators import tables
    df = marked(spark, root).select("opportunity_id", "status", "profit_margin", "confidence_score")
    fresh = df.where(F.col("confidence_score") >= 0.9).withColumn("status", F.lit("active")).withColumn(
        "profit_margin", F.col("profit_margin") + 0.01)
    return tables.replace_active(df, fresh).drop("confidence_score")


@query("j4_insert_absent", """
    SELECT kalshi_id, polymarket_id FROM marked WHERE NOT (status = 'active')""", views=MARKED)
def _(spark, root):
    from crossmarket.operators import tables
    df = marked(spark, root).select("kalshi_id", "polymarket_id", "buy_platform", "status")
    keys = ["kalshi_id", "polymarket_id", "buy_platform"]
    return tables.insert_or_ignore(df.where(F.col("status") == "active"), df, keys).select("kalshi_id", "polymarket_id")


# --- match groups ----------------------------------------------------------------------------

GROUPS = {
    "edges": "SELECT kalshi_id AS a, polymarket_id AS b, confidence_score FROM evals WHERE confidence_score > 0.7",
    "links": "SELECT a, b FROM edges UNION SELECT b, a FROM edges",
    "reach": """SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other""",
    "members": """SELECT node AS market_id, min(other) AS group_id,
        (SELECT max(confidence_score) FROM edges WHERE a = node OR b = node) AS confidence FROM reach GROUP BY node""",
}


def memberships(spark: SparkSession, root: str) -> DataFrame:
    return cut(groups.match_groups(derived.evaluations(spark, root)))


@query("j9_match_groups", "SELECT market_id, group_id, confidence FROM members", views=GROUPS)
def _(spark, root):
    return memberships(spark, root)


@query("j9_group_table", """
    SELECT group_id, count(*) AS members, max(confidence) AS confidence, arg_max(title, (confidence, market_id)) || ' (Group)' AS name
    FROM members JOIN markets ON id = market_id GROUP BY group_id""", views=GROUPS)
def _(spark, root):
    return groups.group_table(memberships(spark, root), derived.markets(spark, root)).select(
        "group_id", "members", "confidence", "name")


def platforms(spark: SparkSession) -> DataFrame:
    from crossmarket.functions import vocab
    return spark.createDataFrame(list(vocab.PLATFORM_SEED), "name string, display_name string, base_url string, "
                                 "api_endpoint string, is_active boolean, rate_limit int, sync_status string")


@query("d15_latest_groups", """
    SELECT g.group_id, m.market_id, k.title, CASE k.platform WHEN 'kalshi' THEN 'Kalshi' ELSE 'Polymarket' END AS platform
    FROM (SELECT DISTINCT group_id FROM members ORDER BY group_id DESC LIMIT 50) g JOIN members m USING (group_id)
    JOIN markets k ON k.id = m.market_id""", views=GROUPS)
def _(spark, root):
    df = groups.latest_groups(memberships(spark, root), derived.markets(spark, root), platforms(spark))
    return df.select("group_id", "market_id", "title", "platform")


@query("d18_ungrouped_markets", """
    SELECT id FROM markets WHERE status = 'active' AND id NOT IN (SELECT market_id FROM members)""", views=GROUPS)
def _(spark, root):
    return groups.unprocessed(derived.markets(spark, root), memberships(spark, root)).select("id")


@query("d29_memberships_of_selection", """
    SELECT market_id, group_id FROM members WHERE market_id IN (SELECT id FROM markets WHERE volume > 9000)""", views=GROUPS)
def _(spark, root):
    chosen = derived.markets(spark, root).where("volume > 9000").select("id")
    return groups.memberships_of(memberships(spark, root), chosen).select("market_id", "group_id")


LEGS = """SELECT {keys} a.id AS buy_market_id, b.id AS sell_market_id, s.buy AS buy_outcome,
      CASE s.buy WHEN 'Yes' THEN 'No' ELSE 'Yes' END AS sell_outcome,
      CASE s.buy WHEN 'Yes' THEN a.yes_price ELSE a.no_price END AS buy_price,
      CASE s.buy WHEN 'Yes' THEN b.no_price ELSE b.yes_price END AS sell_price,
      printf('Buy ''%s'' on %s for %.2f and ''%s'' on %s for %.2f.', s.buy, a.platform,
             CASE s.buy WHEN 'Yes' THEN a.yes_price ELSE a.no_price END, CASE s.buy WHEN 'Yes' THEN 'No' ELSE 'Yes' END,
             b.platform, CASE s.buy WHEN 'Yes' THEN b.no_price ELSE b.yes_price END) AS description"""
LEG_SUM = "round(CASE s.buy WHEN 'Yes' THEN a.yes_price + b.no_price ELSE a.no_price + b.yes_price END, 6)"


def with_outcomes(df: DataFrame) -> DataFrame:
    return df.withColumn("outcomes", F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("price")) for n, c in (
        ("Yes", "yes_price"), ("No", "no_price"))]))


@query("d13_group_legs", f"""
    SELECT *, round(1 - (buy_price + sell_price), 6) AS profit_margin FROM ({LEGS.format(keys='x.group_id,')}
      FROM members x JOIN members y ON x.group_id = y.group_id AND x.market_id < y.market_id
      JOIN markets a ON a.id = x.market_id JOIN markets b ON b.id = y.market_id,
      (VALUES ('Yes'), ('No')) s(buy) WHERE a.platform <> b.platform AND {LEG_SUM} < 1)""", views=GROUPS)
def _(spark, root):
    m = with_outcomes(derived.markets(spark, root)).withColumnRenamed("id", "market_id")
    df = memberships(spark, root).select("market_id", "group_id").join(m, "market_id").withColumnRenamed("market_id", "id")
    return arbitrage.group_legs(df)


@query("d14_selected_legs", f"""
    SELECT *, round(1 - (buy_price + sell_price), 6) AS profit_margin FROM ({LEGS.format(keys='')}
      FROM markets a JOIN markets b ON a.id < b.id, (VALUES ('Yes'), ('No')) s(buy)
      WHERE a.platform <> b.platform AND a.volume > 12000 AND b.volume > 12000 AND {LEG_SUM} < 0.99)""")
def _(spark, root):
    m = cut(with_outcomes(derived.markets(spark, root)).select("id", "platform", "volume", "outcomes"))
    return arbitrage.selected_legs(m, m.where("volume > 12000").select("id"))


@query("d23_edge_legs", """
    SELECT kalshi_id AS buy_market_id, s.buy AS buy_outcome, polymarket_id AS sell_market_id, confidence_score,
           round(1 - CASE s.buy WHEN 'Yes' THEN a.yes_price + b.no_price ELSE a.no_price + b.yes_price END, 6) AS profit_margin
    FROM evals JOIN markets a ON a.id = kalshi_id JOIN markets b ON b.id = polymarket_id, (VALUES ('Yes'), ('No')) s(buy)
    WHERE confidence_score >= 0.7
      AND round(1 - CASE s.buy WHEN 'Yes' THEN a.yes_price + b.no_price ELSE a.no_price + b.yes_price END, 6) > 0.02""")
def _(spark, root):
    strong = derived.evaluations(spark, root).where("confidence_score >= 0.7")
    return arbitrage.edge_legs(strong, derived.markets(spark, root)).select(
        "buy_market_id", "buy_outcome", "sell_market_id", "confidence_score", "profit_margin")


# --- evaluation reports ----------------------------------------------------------------------

def band_sql(bands: int) -> str:
    from crossmarket.functions import vocab
    arms = " ".join(f"WHEN confidence_score >= {low} THEN '{label}'" for label, low in vocab.CONFIDENCE_BANDS[bands][:-1])
    return f"CASE {arms} ELSE '{vocab.CONFIDENCE_BANDS[bands][-1][0]}' END"


for _bands in (5, 6, 7):
    @query(f"e24_confidence_histogram_{_bands}", f"""
        SELECT {band_sql(_bands)} AS confidence_range, count(*) AS pairs, avg(confidence_score) * 100 AS avg_confidence,
               count(*) FILTER (is_equivalent) AS equivalent_count, min(confidence_score) AS lowest FROM evals GROUP BY 1""",
           r="avg_confidence")
    def _(spark, root, bands=_bands):
        return reports.confidence_histogram(derived.evaluations(spark, root), bands)


@query("e25_stage_breakdown", """
    SELECT stage, count(*) AS total_pairs, avg(confidence_score) AS avg_confidence,
           count(*) FILTER (confidence_score >= 0.7) AS high_confidence, count(*) FILTER (is_equivalent) AS equivalent_pairs,
           avg(price_difference) AS avg_price_diff FROM detail GROUP BY stage""", r="avg_confidence avg_price_diff", views=VIEWS)
def _(spark, root):
    return reports.stage_breakdown(detailed(spark, root))


@query("e26_category_matrix", """
    SELECT kalshi_category, polymarket_category, count(*) AS pairs_evaluated, avg(confidence_score) AS avg_confidence,
           max(confidence_score) AS max_confidence, count(*) FILTER (is_equivalent) AS equivalent_count
    FROM detail GROUP BY 1, 2 HAVING count(*) >= 3""", r="avg_confidence", views=VIEWS)
def _(spark, root):
    return reports.category_matrix(detailed(spark, root))


@query("e27_evaluation_totals", """
    SELECT count(*) AS total_evaluations, avg(confidence_score) AS avg_confidence, count(*) FILTER (is_equivalent) AS total_equivalent,
           sum(min_volume) AS addressable_volume, count(DISTINCT kalshi_category) AS kalshi_categories,
           count(DISTINCT polymarket_category) AS polymarket_categories FROM detail""",
       r="avg_confidence addressable_volume", views=VIEWS)
def _(spark, root):
    return reports.evaluation_totals(detailed(spark, root))


@query("e28_confidence_median", """
    SELECT avg(confidence_score) AS avg_confidence, quantile_cont(confidence_score, 0.5) AS median_confidence,
           count(*) FILTER (confidence_score >= 0.5) AS medium_plus FROM evals""", r="avg_confidence median_confidence")
def _(spark, root):
    return reports.confidence_median(derived.evaluations(spark, root))


@query("e29_opportunity_summary", """
    SELECT count(*) AS total, count(*) FILTER (potential_profit > 0.05) AS high_profit, avg(potential_profit) AS avg_profit,
           max(potential_profit) AS max_profit, avg(confidence_score) AS avg_confidence, sum(min_volume) AS total_volume FROM opps""",
       r="avg_profit avg_confidence total_volume", views=OPPS)
def _(spark, root):
    return reports.opportunity_summary(opportunities(spark, root))


@query("e29_opportunities_by_category", """
    SELECT kalshi_category, count(*) AS opportunities, avg(potential_profit) AS avg_profit FROM opps GROUP BY 1""",
       r="avg_profit", views=OPPS)
def _(spark, root):
    return reports.opportunity_by_category(opportunities(spark, root))


@query("e44_evaluation_run_stats", """
    SELECT count(*) AS evaluated, count(*) FILTER (confidence_score >= 0.75) AS accepted,
           1 - count(*) FILTER (confidence_score >= 0.75) / count(*) AS filter_rate, count(*) AS successful, 0 AS failed,
           sum((500 + k % 100) / 1000.0::DOUBLE * 0.03 + (100 + p % 50) / 1000.0::DOUBLE * 0.06) AS total_cost FROM evals""",
       r="filter_rate total_cost")
def _(spark, root):
    df = derived.evaluations(spark, root).withColumn("tin", 500 + F.col("k") % 100).withColumn("tout", 100 + F.col("p") % 50)
    return reports.evaluation_run_stats(df, "tin", "tout").drop("cost_per_evaluation")


@query("e45_processing_log", """
    SELECT stage, count(*) AS output_pairs, avg(confidence_score) AS avg_confidence,
           count(*) FILTER (confidence_score >= 0.7) AS high_confidence_count FROM evals GROUP BY stage""", r="avg_confidence")
def _(spark, root):
    df = derived.evaluations(spark, root)
    return reports.batch_log(df, "screening").unionByName(reports.batch_log(df, "deep_analysis"))


@query("e47_confidence_levels", """
    SELECT count(*) AS total_found, count(*) FILTER (confidence_score > 0.8) AS high,
           count(*) FILTER (confidence_score BETWEEN 0.6 AND 0.8) AS medium, count(*) FILTER (confidence_score < 0.6) AS low FROM evals""")
def _(spark, root):
    return reports.confidence_levels(derived.evaluations(spark, root))


@query("g4_top_evaluated", """
    SELECT kalshi_id, polymarket_id, confidence_score, price_difference FROM detail
    WHERE is_equivalent AND confidence_score >= 0.7 AND price_difference > 0.03
    ORDER BY confidence_score DESC, price_difference DESC, kalshi_id, polymarket_id LIMIT 10""", views=VIEWS)
def _(spark, root):
    return detailed(spark, root).where("is_equivalent AND confidence_score >= 0.7 AND price_difference > 0.03").orderBy(
        F.desc("confidence_score"), F.desc("price_difference"), "kalshi_id", "polymarket_id").limit(10).select(
        "kalshi_id", "polymarket_id", "confidence_score", "price_difference")


@query("g5_top_matches", """
    SELECT kalshi_title, polymarket_title, confidence_score, is_equivalent FROM detail
    ORDER BY confidence_score DESC, kalshi_id, polymarket_id LIMIT 15""", views=VIEWS)
def _(spark, root):
    return detailed(spark, root).orderBy(F.desc("confidence_score"), "kalshi_id", "polymarket_id").limit(15).select(
        "kalshi_title", "polymarket_title", "confidence_score", "is_equivalent")


@query("g6_volume_first", """
    SELECT kalshi_id, polymarket_id, min_volume FROM detail ORDER BY min_volume DESC, kalshi_id, polymarket_id LIMIT 200""", views=VIEWS)
def _(spark, root):
    return detailed(spark, root).orderBy(F.desc("min_volume"), "kalshi_id", "polymarket_id").limit(200).select(
        "kalshi_id", "polymarket_id", "min_volume")


# --- learned model and the full funnel -------------------------------------------------------

@query("k13_metrics_from_predictions", """
    SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall,
           2 * tp / (2 * tp + fp + fn) AS f1
    FROM (SELECT count(*) FILTER (y AND q) AS tp, count(*) FILTER (NOT y AND q) AS fp, count(*) FILTER (y AND NOT q) AS fn,
                 count(*) FILTER (NOT y AND NOT q) AS tn
          FROM (SELECT confidence_score >= 0.8 AS y, price_difference > 0.3 AS q FROM detail))""", r="accuracy recall f1", views=VIEWS)
def _(spark, root):
    df = detailed(spark, root).select((F.col("confidence_score") >= 0.8).cast("double").alias("label"),
                                      (F.col("price_difference") > 0.3).cast("double").alias("prediction"))
    return model.metrics(df)


@query("k15_bucket_success_rates", """
    SELECT bucket, avg(CASE WHEN confidence_score >= 0.8 THEN 1.0 ELSE 0.0 END) AS success_rate, count(*) AS evaluations
    FROM staged JOIN evals USING (kalshi_id, polymarket_id) GROUP BY bucket""", r="success_rate", views=PAIR_VIEWS)
def _(spark, root):
    evaluated = derived.evaluations(spark, root).select("kalshi_id", "polymarket_id", "confidence_score")
    return model.bucket_success(staged_filter.filter_given(evaluated, blocked(spark, root), AS_OF))


def training_rows(spark: SparkSession, root: str) -> DataFrame:
    """Features of the evaluated pairs, labelled by their evaluations."""
    stops = vocab.JACCARD_STOP_WORDS
    bucket = buckets.with_bucket(derived.markets(spark, root)).select(F.col("id").alias("kalshi_id"), "bucket")
    liquidity = [prices.liquidity_score(F.col(f"{v}_volume"), F.col(f"{v}_price")) for v in ("kalshi", "polymarket")]
    pairs = (detailed(spark, root).join(bucket, "kalshi_id")
             .withColumn("text_similarity", text.jaccard(text.tokens(F.col("kalshi_title"), stops),
                                                         text.tokens(F.col("polymarket_title"), stops)))
             .withColumn("liquidity_score", (liquidity[0] + liquidity[1]) / 2))
    return model.dealt(model.labelled(scoring.with_features(pairs, AS_OF)))


FOREST = ModelConfig(kind="random_forest")


@query("k14_model_scores")
def _(spark, root):
    """Score, confidence and prediction of every evaluated pair, by a model fitted on the pairs that are not held out."""
    rows = training_rows(spark, root)
    train_rows, _ = model.split(rows, FOREST)
    scores = model.predict(model.train(train_rows, FOREST), rows)
    return scores.select("kalshi_id", "polymarket_id", "worthiness", "confidence_prediction", "prediction", "label",
                         model.is_held_out(FOREST).alias("held_out"))


@query("k15_model_quality")
def _(spark, root):
    """Measures of the model of k14: value, and null where there is no model to measure."""
    rows = training_rows(spark, root)
    train_rows, test_rows = model.split(rows, FOREST)
    fitted = model.train(train_rows, FOREST)
    return model.quality(fitted, train_rows, test_rows, FOREST)


@query("k29_full_funnel", f"""
    SELECT kalshi_id, polymarket_id, bucket, worthiness, confidence_score, profit, risk_level, priority FROM found""",
       r="worthiness profit priority", views={
           **PAIR_VIEWS,
           "detail": """SELECT s.*, e.confidence_score, s.kalshi_close_time AS kalshi_close, s.polymarket_close_time AS polymarket_close,
                  least(s.kalshi_volume, s.polymarket_volume) AS min_volume
               FROM scored s JOIN evals e ON e.kalshi_id = s.kalshi_id AND e.polymarket_id = s.polymarket_id
               WHERE round(s.worthiness, 9) >= 0.3""",
           **{n: v for n, v in ECON.items() if n != "detail"},
           "sized": ECON["sized"].replace("abs(epoch(kalshi_close) - epoch(polymarket_close)) AS apart,", ""),
       })
def _(spark, root):
    from crossmarket.plans import funnel
    return funnel.run(derived.markets(spark, root), derived.evaluations(spark, root), AS_OF).select(
        "kalshi_id", "polymarket_id", "bucket", "worthiness", "confidence_score", F.col("expected_profit_usd").alias("profit"),
        "risk_level", F.col("priority_score").alias("priority"))
