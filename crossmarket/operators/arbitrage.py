"""Economics of evaluated pairs: strategy, size, costs, risk, metrics, ranking; and group legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.config import ArbitrageConfig
from crossmarket.functions import dates, prices, vocab
from crossmarket.operators.intervals import around, price_cell, up_to
from crossmarket.operators.pairing import slice_join
from crossmarket.sources.checkpoints import cut


def smaller_volume() -> Column:
    return F.least("kalshi_volume", "polymarket_volume")


def arbitrage_type() -> Column:
    """Simple gap, else temporal, else liquidity imbalance, else cross-platform."""
    apart = dates.seconds_apart(F.col("kalshi_close_time"), F.col("polymarket_close_time"))
    ratio = prices.volume_ratio(F.col("kalshi_volume"), F.col("polymarket_volume"))
    return (F.when(F.col("price_difference") >= 0.05, "simple_arbitrage").when(apart > 86400, "temporal_arbitrage")
            .when(ratio < 0.3, "liquidity_arbitrage").otherwise("cross_platform"))


def strategy() -> Column:
    cheap_k = F.col("kalshi_price") < F.col("polymarket_price")
    return F.struct(
        F.when(cheap_k, "kalshi").otherwise("polymarket").alias("buy_platform"),
        F.when(cheap_k, "polymarket").otherwise("kalshi").alias("sell_platform"),
        F.least("kalshi_price", "polymarket_price").alias("buy_price"),
        F.greatest("kalshi_price", "polymarket_price").alias("sell_price"),
        F.lit("simultaneous").alias("execution_order"), F.lit(True).alias("hedge_required"),
        F.lit(60).alias("max_execution_time_minutes"))


def position_size(cfg: ArbitrageConfig) -> Column:
    """Least of the volume share, the cap and the capped Kelly stake; NULL without a gap."""
    gap = F.col("price_difference")
    kelly = F.try_divide(gap * cfg.win_rate - (1 - cfg.win_rate), gap)
    stake = F.greatest(F.lit(0.0), F.least(F.lit(cfg.kelly_cap), kelly)) * cfg.max_position
    size = F.least(smaller_volume() * cfg.volume_share, F.lit(cfg.max_position), stake)
    return F.when(gap > 0, F.round(size.cast("decimal(28,8)"), 2).cast("double"))


def costs(cfg: ArbitrageConfig) -> Column:
    """Fees of both venues, gas, and slippage capped at one percent a side."""
    size = F.col("position_size")
    slip = lambda v: F.least(F.lit(0.01), F.try_divide(size, F.col(v)) * 0.5)
    kalshi, poly = size * cfg.kalshi_fee, size * cfg.polymarket_fee
    slippage = size * (slip("kalshi_volume") + slip("polymarket_volume"))
    total = kalshi + poly + cfg.gas_usd + slippage
    return F.struct(kalshi.alias("kalshi_fee"), poly.alias("polymarket_fee"),
                    F.lit(cfg.gas_usd).alias("gas_cost"), slippage.alias("slippage_cost"),
                    total.alias("total_cost"), F.try_divide(total, size).alias("cost_percentage"))


def steps(value: Column, bounds: list[tuple[float, float]], last: float, above: bool) -> Column:
    """First listed result whose bound the value is above (or below)."""
    chain = None
    for bound, result in bounds:
        hit = value > bound if above else value < bound
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return chain.otherwise(F.lit(last))


def liquidity_risk() -> Column:
    return steps(smaller_volume(), [(10000, 0.1), (5000, 0.2), (1000, 0.4), (500, 0.6)], 0.8, True)


def timing_risk() -> Column:
    hours = dates.hours_apart(F.col("kalshi_close_time"), F.col("polymarket_close_time"))
    return steps(hours, [(1, 0.1), (24, 0.2), (168, 0.4)], 0.7, False)


def execution_risk() -> Column:
    gap = F.col("price_difference")
    return F.when(gap < 0.02, 0.3).when(gap > 0.2, 0.4).otherwise(0.2)


def risk_level(score: Column) -> Column:
    return steps(score, [(b, n) for n, b in vocab.RISK_LEVELS], vocab.RISK_LEVEL_TOP, False)


def listed(*items: tuple[Column | None, str]) -> Column:
    """Array of the texts whose condition holds."""
    texts = F.array(*[F.lit(t) if c is None else F.when(c, F.lit(t)) for c, t in items])
    return F.filter(texts, lambda t: t.isNotNull())


def with_risk(pairs: DataFrame, cfg: ArbitrageConfig) -> DataFrame:
    pairs = pairs.withColumns({
        "liquidity_risk": liquidity_risk(), "timing_risk": timing_risk(),
        "execution_risk": execution_risk(), "correlation_risk": 1.0 - F.col("semantic_similarity")})
    parts = [F.col("liquidity_risk"), F.col("timing_risk"), F.col("execution_risk"),
             F.col("correlation_risk"), F.lit(cfg.platform_risk)]
    score = F.lit(0.0)
    for weight, part in zip(cfg.risk_weights, parts):
        score = score + part * weight
    low, late = F.col("liquidity_risk") > 0.3, F.col("timing_risk") > 0.3
    return (pairs.withColumn("risk_score", F.round(score, 6))
            .withColumn("risk_level", risk_level(F.col("risk_score")))
            .withColumn("primary_risks", listed(
                (low, vocab.RISK_TEXTS["liquidity"]), (late, vocab.RISK_TEXTS["timing"]),
                (F.col("correlation_risk") > 0.2, vocab.RISK_TEXTS["correlation"]),
                (F.col("execution_risk") > 0.3, vocab.RISK_TEXTS["execution"])))
            .withColumn("mitigation_strategies", listed(
                (low, vocab.MITIGATION_TEXTS["liquidity"]), (late, vocab.MITIGATION_TEXTS["timing"]),
                (None, vocab.MITIGATION_TEXTS["limit_orders"]), (None, vocab.MITIGATION_TEXTS["monitor"]))))


def with_metrics(pairs: DataFrame, as_of: str) -> DataFrame:
    size, risk = F.col("position_size"), F.col("risk_score")
    net = F.round(F.col("price_difference") * size - F.col("transaction_costs.total_cost"), 6)
    share = F.when(size > 0, F.round(net / size, 6)).otherwise(F.lit(0.0))
    first_close = F.least("kalshi_close_time", "polymarket_close_time")
    days = (dates.epoch(first_close) - dates.epoch(dates.as_timestamp(as_of))) / 86400.0
    success = F.greatest(F.lit(0.5), F.lit(1.0) - risk)
    return (pairs.withColumn("expected_profit_usd", net).withColumn("expected_profit_percentage", share)
            .withColumn("roi_percentage", F.when(days > 0, F.round(
                F.col("expected_profit_percentage") * 365 / F.greatest(F.lit(1.0), days), 6)).otherwise(0.0))
            .withColumn("success_probability", success)
            .withColumn("execution_minutes", F.greatest(
                F.lit(30), F.floor(F.round(F.col("execution_risk") * 120, 6)).cast("int")))
            .withColumn("price_stability_score", 1.0 - F.col("price_difference"))
            .withColumn("liquidity_metric", 1.0 - F.col("liquidity_risk")))


def priority_score() -> Column:
    profit = F.least(F.lit(1.0), F.col("expected_profit_percentage") / 0.1)
    roi = F.least(F.lit(1.0), F.col("roi_percentage") / 100.0)
    value = (profit * 0.4 + roi * 0.3 + (1.0 - F.col("risk_score")) * 0.2
             + F.col("success_probability") * 0.1)
    return F.round(F.round(value, 8), 3)


def expiry(as_of: str, cfg: ArbitrageConfig) -> Column:
    deadline = dates.as_timestamp(as_of) + F.make_dt_interval(F.lit(0), F.lit(cfg.deadline_hours))
    closes = F.least("kalshi_close_time", "polymarket_close_time").cast("timestamp")
    return F.least(closes, deadline)


def analyze(evaluated: DataFrame, as_of: str, cfg: ArbitrageConfig = ArbitrageConfig()) -> DataFrame:
    """All economics columns for evaluated pairs (price_difference and semantic_similarity given)."""
    sized = (evaluated.withColumn("arbitrage_type", arbitrage_type()).withColumn("strategy", strategy())
             .withColumn("position_size", position_size(cfg)).withColumn("transaction_costs", costs(cfg)))
    return (with_metrics(with_risk(sized, cfg), as_of).withColumn("priority_score", priority_score())
            .withColumn("expires_at", expiry(as_of, cfg)).withColumn("status", F.lit("detected"))
            .withColumn("detected_at", dates.as_timestamp(as_of))
            .withColumn("opportunity_id", F.concat_ws("_", F.lit("arb"), "kalshi_id", "polymarket_id")))


def risk_allowed(level: Column, cfg: ArbitrageConfig) -> Column:
    """Ordinal gate (intended) or the literal string comparison of level names."""
    if cfg.risk_gate == "literal":
        return level <= F.lit(cfg.max_risk)
    order = [n for n, _ in vocab.RISK_LEVELS] + [vocab.RISK_LEVEL_TOP]
    return level.isin(order[: order.index(cfg.max_risk) + 1])


def profitable(opportunities: DataFrame, cfg: ArbitrageConfig = ArbitrageConfig()) -> DataFrame:
    return opportunities.where(
        (F.col("expected_profit_usd") >= cfg.min_profit_usd)
        & (F.col("expected_profit_percentage") >= cfg.min_profit_share)
        & risk_allowed(F.col("risk_level"), cfg))


def detect(evaluated: DataFrame, as_of: str, cfg: ArbitrageConfig = ArbitrageConfig()) -> DataFrame:
    """Opportunities among confidently evaluated pairs."""
    sure = evaluated.where(F.col("confidence_score") >= cfg.min_confidence)
    return profitable(analyze(sure, as_of, cfg), cfg)


def ranked(opportunities: DataFrame, limit: int | None = None) -> DataFrame:
    result = opportunities.orderBy(F.desc("priority_score"), "kalshi_id", "polymarket_id")
    return result if limit is None else result.limit(limit)


def performance_summary(opportunities: DataFrame) -> DataFrame:
    best = F.max_by("opportunity_id", F.struct("priority_score", "kalshi_id", "polymarket_id"))
    levels = [n for n, _ in vocab.RISK_LEVELS] + [vocab.RISK_LEVEL_TOP]
    return opportunities.agg(
        F.count(F.lit(1)).alias("total_opportunities"), F.sum("expected_profit_usd").alias("total_potential_profit"),
        F.avg("expected_profit_percentage").alias("avg_profit_percentage"),
        F.avg("roi_percentage").alias("avg_roi_percentage"), F.avg("risk_score").alias("avg_risk_score"),
        *[F.count_if(F.col("risk_level") == n).alias(f"risk_{n}") for n in levels], best.alias("top_opportunity"))


def contract_view(opportunities: DataFrame, invested: float = 1000.0) -> DataFrame:
    """Nested buy/sell projection of the service contract (return is for `invested` dollars)."""
    cheap_k = F.col("kalshi_price") < F.col("polymarket_price")

    def leg(buy: bool) -> Column:
        mine = cheap_k if buy else ~cheap_k
        pick = lambda c: F.when(mine, F.col(f"kalshi_{c}")).otherwise(
            F.col(f"polymarket_{c}"))
        return F.struct(pick("title").alias("title"),
                        F.when(mine, "kalshi").otherwise("polymarket").alias("platform"),
                        pick("id").alias("externalId"), F.lit("Yes" if buy else "No").alias("outcome"),
                        pick("price").alias("price"), pick("volume").alias("volume"))

    return opportunities.select(
        F.col("opportunity_id").alias("id"), leg(True).alias("buyMarket"), leg(False).alias("sellMarket"),
        F.col("expected_profit_percentage").alias("profitMargin"), F.col("confidence_score").alias("confidence"),
        F.col("kalshi_category").alias("category"), F.col("risk_level").alias("riskLevel"),
        F.col("detected_at").alias("detectedAt"), F.col("expires_at").alias("expiresAt"),
        F.lit(10.0).alias("minInvestment"), F.col("position_size").alias("maxInvestment"),
        F.round(F.col("expected_profit_percentage") * invested, 6).alias("estimatedReturn"))


def with_yes_no(members: DataFrame) -> DataFrame:
    """Members that are proper Yes/No markets, with both prices."""
    find = lambda name: F.try_element_at(F.filter(
        "outcomes", lambda o: F.lower(o["name"]) == name), F.lit(1))["price"].cast("double")
    return (members.where(F.size("outcomes") == 2).withColumn("yes", find("yes")).withColumn("no", find("no"))
            .where(F.col("yes").isNotNull() & F.col("no").isNotNull()))


def _leg_directions(pairs: DataFrame, limit: float, keep: tuple[str, ...]) -> DataFrame:
    """Both ways of buying Yes on one side and No on the other below a combined price."""
    parts = []
    for buy, sell in (("Yes", "No"), ("No", "Yes")):
        a, b = F.col(f"a_{buy.lower()}"), F.col(f"b_{sell.lower()}")
        margin = prices.on_grid(1.0 - (a + b))
        way = pairs.where(F.col("_first") == buy.lower()) if "_first" in pairs.columns else pairs
        parts.append(way.where(prices.on_grid(a + b) < limit).select(
            *keep, F.col("a_id").alias("buy_market_id"), F.col("b_id").alias("sell_market_id"),
            F.lit(buy).alias("buy_outcome"), F.lit(sell).alias("sell_outcome"), a.alias("buy_price"),
            b.alias("sell_price"), margin.alias("profit_margin"),
            F.format_string(f"Buy '{buy}' on %s for %.2f and '{sell}' on %s for %.2f.", F.col("a_platform"), a,
                            F.col("b_platform"), b).alias("description")))
    return parts[0].unionByName(parts[1])


def _cheap_pairs(priced: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Pairs of one key and different venues, smaller id first, that are below the limit in at least one direction.

    "My price plus yours is below the limit" is a range of the other's price cells, looked up as intervals, so pairs that
    are too dear never meet, however many rows a key has. The listings are read eight times, so they are written once.
    """
    columns = ("id", "platform", "yes", "no")
    listings = cut(priced.select(*keys, *columns))
    side = lambda t: listings.select(*keys, *[F.col(c).alias(f"{t}_{c}") for c in columns])
    found = None
    for mine, other in (("yes", "no"), ("no", "yes")):
        filed = side("a").withColumn("_at", F.explode(around(price_cell(F.col(f"a_{mine}")))))
        # One cell more than the price allows, for prices that round up to it.
        room = F.floor((limit - F.col(f"b_{other}")) * 100).cast("int") + 1
        asked = side("b").withColumn("_at", F.explode(up_to(room)))
        wanted = ((F.col("a_id") < F.col("b_id")) & (F.col("a_platform") != F.col("b_platform"))
                  & (prices.on_grid(F.col(f"a_{mine}") + F.col(f"b_{other}")) < limit))
        part = slice_join(filed, asked, [*keys, "_at"], "a_id", "b_id", wanted).drop("_at").withColumn("_first", F.lit(mine))
        found = part if found is None else found.unionByName(part)
    return found


def group_legs(members: DataFrame, keys: tuple[str, ...] = ("group_id",), limit: float = 1.0) -> DataFrame:
    """Yes-plus-No below the limit across venues, inside each match group.

    Members need id, platform, outcomes and the group keys.
    """
    return _leg_directions(_cheap_pairs(with_yes_no(members), list(keys), limit), limit, keys)


def selected_legs(markets: DataFrame, selection: DataFrame, threshold: float = 0.99) -> DataFrame:
    """The same inside a user's selection, by outcome position and a stricter limit."""
    chosen = markets.join(selection.select("id").distinct(), "id", "left_semi").where(F.size("outcomes") == 2)
    priced = chosen.withColumn("yes", F.col("outcomes")[0]["price"].cast("double")).withColumn(
        "no", F.col("outcomes")[1]["price"].cast("double")).where("yes IS NOT NULL AND no IS NOT NULL")
    return _leg_directions(_cheap_pairs(priced, [], threshold), threshold, ())


def edge_legs(similarities: DataFrame, markets: DataFrame, min_margin: float = 0.02) -> DataFrame:
    """Legs across similarity edges with a margin above the minimum."""
    sides = similarities.select("kalshi_id", "polymarket_id", "confidence_score")
    for venue, tag in (("kalshi", "a"), ("polymarket", "b")):
        listing = markets.where(F.col("platform") == venue).select(
            F.col("id").alias(f"{venue}_id"), F.col("yes_price").alias(f"{tag}_yes"),
            F.col("no_price").alias(f"{tag}_no"), F.lit(venue).alias(f"{tag}_platform"))
        sides = sides.join(listing, f"{venue}_id")
    pairs = sides.withColumnRenamed("kalshi_id", "a_id").withColumnRenamed("polymarket_id", "b_id")
    return _leg_directions(pairs, 1.0, ("confidence_score",)).where(F.col("profit_margin") > min_margin)
