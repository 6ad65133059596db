"""External evaluations: prompts out, replies in, joined back to the listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.config import EvaluationConfig
from crossmarket.functions import prices, replies, text, vocab
from crossmarket.operators import staged_filter
from crossmarket.sources.checkpoints import cut

Evaluator = Callable[[DataFrame], DataFrame]


def day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))


def numbered(pairs: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Adds batch_id and position (from 1) for batches of a fixed size in the given order.

    A global row number without a single-task window: rows are range-partitioned by the order,
    numbered inside each partition, and shifted by the sizes of the partitions before.
    """
    ranged = pairs.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the generated id are the partition, the lower bits the row inside it.
    # Written out, because the ids must not change if a partition is computed again.
    sequence = F.monotonically_increasing_id()
    tagged = cut(ranged.withColumn("_part", F.shiftright(sequence, 33))
                 .withColumn("_row", sequence.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = tagged.groupBy("_part").agg(F.max("_row").alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_shift"))
    index = F.col("_shift") + F.col("_row")
    return (tagged.join(shift, "_part")
            .withColumn("batch_id", F.floor(index / size)).withColumn("position", index % size + 1)
            .drop("_part", "_row", "_shift"))


def adaptive_batches(scored: DataFrame, score: str, order: list[Column]) -> DataFrame:
    """Batches of 3, 10 or 20 pairs for high, medium and low scores."""
    value = F.col(score)
    tiers = (("high", value >= 100, 3), ("medium", (value >= 60) & (value < 100), 10), ("low", value < 60, 20))
    parts = [numbered(scored.where(cond), order, size).withColumn("tier", F.lit(tier))
             for tier, cond, size in tiers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pair_entry(style: str) -> Column:
    """Text of one pair inside a batch prompt."""
    price = lambda v: F.format_string("%.3f", F.col(f"{v}_price"))
    gap = F.format_string("%.3f", F.abs(F.col("kalshi_price") - F.col("polymarket_price")))
    lines = [F.concat(F.lit("PAIR "), F.col("position").cast("string"))]
    for venue in ("kalshi", "polymarket"):
        head = F.concat(F.lit(f"{venue.upper()}: "), F.col(f"{venue}_title"), F.lit(" | "),
                        F.col(f"{venue}_category"), F.lit(" | "), price(venue))
        if style == "screening":
            lines.append(head)
            continue
        length = 200 if style == "batch" else 300
        details = text.short_description(F.col(f"{venue}_description"), F.col(f"{venue}_title"), length)
        lines.append(F.concat(head, F.lit(" | closes "), day(F.col(f"{venue}_close_time")),
                              F.lit(" | "), details))
    if style != "batch":
        lines.append(F.concat(F.lit("gap "), gap))
    return F.concat_ws("\n", *lines)


INSTRUCTIONS = {
    "screening": "Rate from 0 to 1 how likely each pair of listings is about one event.",
    "batch": "Rate from 0 to 1 whether each pair of listings resolves on one event by one rule.",
    "deep": "Compare dates, conditions and resolution rules of each pair; rate from 0 to 1.",
}
ANSWER_FORMAT = 'Answer one line per pair: PAIR n: confidence=0.00, reasoning="..."'


def batch_prompts(batched: DataFrame, style: str = "batch") -> DataFrame:
    """One prompt per batch; batches are small by construction, so collecting them is bounded."""
    entries = batched.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("position", pair_entry(style).alias("entry")))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n")
    return entries.select("batch_id", F.size("e").alias("pairs"), F.concat_ws(
        "\n\n", F.lit(INSTRUCTIONS[style]), body, F.lit(ANSWER_FORMAT)).alias("prompt"))


def pair_prompt() -> Column:
    """Prompt for a single scored pair, answered as JSON."""
    fields = (("kalshi", F.col("kalshi_title")), ("polymarket", F.col("polymarket_title")),
              ("gap", F.format_string("%.3f", F.col("price_difference"))),
              ("prices", F.format_string("%.3f / %.3f", F.col("kalshi_price"), F.col("polymarket_price"))),
              ("categories", F.concat_ws(" / ", "kalshi_category", "polymarket_category")),
              ("similarity", F.format_string("%.2f", prices.on_grid(F.col("text_similarity"), 9))),
              ("closes", F.concat_ws(" / ", day(F.col("kalshi_close_time")), day(F.col("polymarket_close_time")))),
              ("score", F.format_string("%.3f", prices.on_grid(F.col("worthiness"), 9))))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields],
                       F.lit("Answer as JSON with confidence_score, reasoning, semantic_similarity, "
                             "arbitrage_viability, risk_assessment, recommended_action"))


def parse_line_replies(batched: DataFrame, reply_table: DataFrame,
                       cfg: EvaluationConfig = EvaluationConfig(), threshold: float | None = None) -> DataFrame:
    """Line replies aligned by position: the n-th PAIR line answers the n-th pair of its batch."""
    lines = F.filter(F.split("reply", "\n"), lambda line: F.ltrim(line).startswith("PAIR"))
    answered = reply_table.select("batch_id", F.posexplode(lines).alias("_at", "line")).withColumn(
        "position", (F.col("_at") + 1).cast("bigint"))
    score = replies.line_confidence(F.col("line"))
    return (batched.join(answered.drop("_at"), ["batch_id", "position"])
            .withColumn("confidence_score", score).withColumn("reasoning", replies.line_reasoning(F.col("line")))
            .withColumn("is_equivalent", score >= (threshold or cfg.equivalent)).drop("line"))


def with_fallback(pairs: DataFrame, parsed: DataFrame, error: str = "no reply") -> DataFrame:
    """Every pair gets an evaluation; pairs without a reply a zero-confidence fallback."""
    return _filled(pairs.join(parsed, ["kalshi_id", "polymarket_id"], "left"), error)


def staged_with_fallback(bucketed: DataFrame, parsed: DataFrame, as_of: str, error: str = "no reply") -> DataFrame:
    """`with_fallback` of the pairs that pass the stages.

    Pairs with an evaluation are looked up from it, all others are told apart while they are formed, so only listings and
    evaluations are shuffled, not pairs.
    """
    answered = staged_filter.filter_given(parsed, bucketed, as_of)
    none = {f.name: F.lit(None).cast(f.dataType) for f in parsed.schema if f.name not in ("kalshi_id", "polymarket_id")}
    others = staged_filter.filter_unlisted(bucketed, parsed, as_of).withColumns(none)
    return _filled(answered, error).unionByName(_filled(others.select(answered.columns), error))


def _filled(joined: DataFrame, error: str) -> DataFrame:
    missing = F.col("confidence_score").isNull()
    return (joined.withColumn("provider_used", F.when(missing, "fallback").otherwise("table"))
            .withColumn("semantic_similarity", F.coalesce("semantic_similarity", "text_similarity", F.lit(0.0)))
            .withColumn("arbitrage_viability", F.coalesce("arbitrage_viability", "price_difference", F.lit(0.0)))
            .withColumn("reasoning", F.coalesce("reasoning", F.lit(
                vocab.FALLBACK_TEXTS["reasoning"].format(error=error))))
            .withColumn("risk_assessment", F.coalesce(
                "risk_assessment", F.lit(vocab.FALLBACK_TEXTS["risk"])))
            .withColumn("recommended_action", F.coalesce("recommended_action", F.lit(vocab.FALLBACK_TEXTS["action"])))
            .withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0.0))))


def table_evaluator(reply_table: DataFrame) -> Evaluator:
    """Default evaluator: replies already in a table keyed by pair_hash."""
    def evaluate(pairs: DataFrame) -> DataFrame:
        return pairs.join(reply_table.select("pair_hash", "reply"), "pair_hash")
    return evaluate


def evaluate_pairs(pairs: DataFrame, evaluator: Evaluator) -> DataFrame:
    """Runs any evaluator (pairs -> pairs with reply) and parses its JSON replies."""
    return evaluator(pairs).withColumn("_r", replies.json_reply(F.col("reply"))).select(
        "*", "_r.*").drop("_r", "reply")


def hash_of_pair() -> Column:
    return text.pair_hash(F.col("kalshi_id"), F.col("polymarket_id"), F.col("kalshi_title"),
                          F.col("polymarket_title"))


def cache_lookup(pairs: DataFrame, cache: DataFrame, as_of: str,
                 hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): evaluations by pair hash no older than the limit, and pairs without one."""
    keyed = pairs.withColumn("pair_hash", hash_of_pair())
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(
        F.col("cached_at").cast("timestamp"))
    fresh = cache.where(age <= hours * 3600)
    return keyed.join(fresh, "pair_hash"), keyed.join(fresh.select("pair_hash"), "pair_hash", "left_anti")


def with_both_markets(evaluations: DataFrame, markets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Evaluations joined to both listings on their ids (no broadcast: either may be large)."""
    result = evaluations
    for venue in ("kalshi", "polymarket"):
        listing = markets.where(F.col("platform") == venue).select(
            F.col("id").alias(f"{venue}_id"), *[F.col(c).alias(f"{venue}_{c}") for c in columns])
        result = result.join(listing, f"{venue}_id")
    return result


def evaluation_details(evaluations: DataFrame, markets: DataFrame) -> DataFrame:
    """Prices, gap and smaller volume of every evaluated pair; unknown listings count as zero."""
    result = evaluations
    for venue in ("kalshi", "polymarket"):
        listing = markets.where(F.col("platform") == venue).select(
            F.col("id").alias(f"{venue}_id"), F.col("yes_price").alias(f"_{venue}_price"),
            F.col("volume").alias(f"_{venue}_volume"))
        result = result.join(listing, f"{venue}_id", "left")
    known = F.col("_kalshi_price").isNotNull() & F.col("_polymarket_price").isNotNull()
    value = lambda c: F.when(known, F.col(c)).otherwise(0.0)
    return (result.withColumn("kalshi_price", value("_kalshi_price"))
            .withColumn("polymarket_price", value("_polymarket_price"))
            .withColumn("price_difference", prices.gap(F.col("kalshi_price"), F.col("polymarket_price")))
            .withColumn("min_volume", F.when(known, F.least("_kalshi_volume", "_polymarket_volume")).otherwise(0.0))
            .drop("_kalshi_price", "_polymarket_price", "_kalshi_volume", "_polymarket_volume"))


def evaluated_opportunities(evaluations: DataFrame, markets: DataFrame, *, fee: float = 0.02,
                            min_gap: float = 0.03, min_volume: float = 100.0, divisor: float = 10.0,
                            confidence_weight: bool = False, threshold: float = 0.7) -> DataFrame:
    """Equivalent pairs with a gap worth trading, after fees, with a risk-adjusted score."""
    joined = with_both_markets(evaluations.where(F.col("confidence_score") >= threshold), markets,
                               ("title", "category", "yes_price", "volume", "liquidity"))
    gap = prices.gap(F.col("kalshi_yes_price"), F.col("polymarket_yes_price"))
    volume = F.least("kalshi_volume", "polymarket_volume")
    rows = (joined.withColumn("price_difference", gap).withColumn("min_volume", volume)
            .where((F.col("price_difference") > min_gap) & (F.col("min_volume") > min_volume)))
    profit = prices.net_gap(F.col("price_difference"), fee)
    weight = F.col("confidence_score") if confidence_weight else None
    return rows.withColumn("potential_profit", profit).withColumn(
        "risk_adjusted_score", prices.risk_adjusted(F.col("potential_profit"), F.col("min_volume"), divisor, weight))


def confidence_gates(evaluations: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """How many evaluations pass each threshold."""
    score = F.col("confidence_score")
    return evaluations.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(score >= cfg.screen).alias("screened"),
        F.count_if(score >= cfg.equivalent).alias("equivalent"),
        F.count_if(score >= cfg.accept).alias("accepted"), F.count_if(score >= cfg.high).alias("high_confidence"))
