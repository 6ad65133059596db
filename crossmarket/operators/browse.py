"""Listing filters, searches and paged reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.functions import outcomes, prices, text


def open_listings(df: DataFrame, as_of_iso: str) -> DataFrame:
    """Future close (compared as ISO text), tradable state, an id and a title."""
    named = (F.length(F.coalesce("ticker", F.lit(""))) > 0) | (F.length(F.coalesce("id", F.lit(""))) > 0)
    return df.where((F.col("close_time") > as_of_iso) & F.col("status").isin("active", "initialized") & named
                    & (F.length(F.coalesce("title", F.lit(""))) > 0))


def tradability(as_of_iso: str, quotes: bool = True) -> Column:
    """Active, closable early, open, and with volume, liquidity, interest or a two-sided quote."""
    at_least = lambda c, v: F.coalesce(prices.number(F.col(c)), F.lit(0.0)) > v
    traded = at_least("volume", 0) | at_least("liquidity", 1000) | at_least("open_interest", 0)
    if quotes:
        traded = traded | (at_least("yes_bid", 0) & at_least("yes_ask", 0))
    return ((F.col("status") == "active") & F.coalesce("can_close_early", F.lit(False))
            & (F.col("close_time") > as_of_iso) & traded)


def activity(as_of_iso: str) -> Column:
    """Stricter test: also needs some price; looser on state and liquidity."""
    some = lambda c: F.coalesce(prices.number(F.col(c)), F.lit(0.0)) > 0
    return (F.col("status").isin("active", "initialized") & F.coalesce("can_close_early", F.lit(False))
            & (some("liquidity") | some("volume") | some("open_interest"))
            & (some("yes_bid") | some("yes_ask") | some("last_price")) & (F.col("close_time") > as_of_iso))


def payload_number(path: str) -> Column:
    return F.get_json_object("raw_data", f"$.{path}").try_cast("double")


def payload_whole(path: str) -> Column:
    return F.round(payload_number(path)).cast("bigint")


def truly_active() -> Column:
    """Traded, liquid or held according to the raw payload, and in active state."""
    used = ((payload_whole("volume") > 0) | (payload_number("liquidity") > 1000)
            | (payload_whole("open_interest") > 0))
    return F.coalesce(used & (F.get_json_object("raw_data", "$.status") == "active"), F.lit(False))


def priced() -> Column:
    return F.col("lastTradePrice").isNotNull() | (F.col("bestBid").isNotNull() & F.col("bestAsk").isNotNull())


def valid_binary(df: DataFrame) -> DataFrame:
    """Id, question, binary outcomes and some price."""
    return df.where((F.length(F.coalesce("id", F.lit(""))) > 0) & (F.length(F.coalesce("question", F.lit(""))) > 0)
                    & outcomes.is_binary(F.col("outcomes")) & priced())


def quality_flags(df: DataFrame, as_of: str) -> DataFrame:
    """The record quality gate as columns; should_process combines them."""
    in_range = F.forall("outcomes", lambda o: o["price"].between(0, 1))
    flagged = df.withColumns({
        "has_title": F.length(F.coalesce("title", F.lit(""))) > 0,
        "has_category": F.length(F.coalesce("category", F.lit(""))) > 0,
        "has_binary_outcomes": F.size("outcomes") == 2, "has_valid_prices": F.coalesce(in_range, F.lit(False)),
        "is_active_market": F.coalesce(F.col("is_active"), F.lit(False)),
        "has_end_date": F.coalesce(F.col("close_time") > F.lit(as_of).cast("timestamp"), F.lit(False))})
    return flagged.withColumn("should_process", F.expr(
        "has_title AND has_category AND has_binary_outcomes AND has_valid_prices AND is_active_market"))


@dataclass(frozen=True)
class Browse:
    platform: str | None = None
    category: str | None = None
    min_volume: float | None = None
    max_volume: float | None = None
    min_liquidity: float | None = None
    max_liquidity: float | None = None
    end_before: str | None = None
    count: int = 50


def matching(df: DataFrame, ask: Browse) -> DataFrame:
    """Active listings satisfying the given bounds; every predicate can reach the scan."""
    df = df.where(F.col("status") == "active")
    equal = {"platform": ask.platform, "category": ask.category}
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    bounds = ((ask.min_volume, lambda v: F.col("volume") >= v), (ask.max_volume, lambda v: F.col("volume") <= v),
              (ask.min_liquidity, lambda v: F.col("liquidity") >= v),
              (ask.max_liquidity, lambda v: F.col("liquidity") <= v),
              (ask.end_before, lambda v: F.col("close_time") <= F.lit(v).cast("timestamp_ntz")))
    for value, make in bounds:
        if value is not None:
            df = df.where(make(value))
    return df


def newest(df: DataFrame, ask: Browse) -> DataFrame:
    return matching(df, ask).orderBy(F.desc("open_time"), "id").limit(ask.count)


def search(df: DataFrame, phrase: str, ask: Browse = Browse()) -> DataFrame:
    """Titles sharing words with the phrase, most shared words first."""
    wanted = text.string_array(sorted(set(phrase.lower().split())))
    rank = F.size(F.array_intersect(text.tokens(F.col("title")), wanted))
    return (matching(df, ask).withColumn("match_rank", rank).where(F.col("match_rank") > 0)
            .orderBy(F.desc("match_rank"), "id").limit(ask.count))


def page_after(df: DataFrame, ask: Browse, cursor: tuple[str, str] | None = None) -> DataFrame:
    """Next page after (open_time, id) of the last row seen; no offset is skipped over."""
    found = matching(df, ask)
    if cursor is not None:
        when, row_id = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
        found = found.where((F.col("open_time") < when)
                            | ((F.col("open_time") == when) & (F.col("id") > row_id)))
    return found.orderBy(F.desc("open_time"), "id").limit(ask.count)


def with_platform_names(df: DataFrame, platforms: DataFrame) -> DataFrame:
    """Display name of the platform, else its name, else Unknown."""
    names = platforms.select(F.col("name").alias("platform"), "display_name", F.col("name").alias("_n"))
    return df.join(names, "platform", "left").withColumn(
        "platform_display_name", F.coalesce("display_name", "_n", F.lit("Unknown"))).drop("display_name", "_n")


def live_opportunities(df: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    return (df.where((F.col("status") == "detected") & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
            .orderBy(F.desc("priority_score"), F.desc("expected_profit_usd"), "opportunity_id").limit(limit))


def top_margins(df: DataFrame, minimum: float = 0.02, limit: int = 50) -> DataFrame:
    return (df.where((F.col("status") == "active") & (F.col("profit_margin") >= minimum))
            .orderBy(F.desc("profit_margin"), "opportunity_id").limit(limit))


def with_both_sides(opportunities: DataFrame, markets: DataFrame) -> DataFrame:
    """Opportunities with buy and sell listing (joined on venue and external id)."""
    result = opportunities
    for tag in ("buy", "sell"):
        listing = markets.select(F.col("platform").alias(f"{tag}_platform"),
                                 F.col("external_id").alias(f"{tag}_external_id"),
                                 F.col("title").alias(f"{tag}_title"), F.col("yes_price").alias(f"{tag}_yes_price"))
        result = result.join(listing, [f"{tag}_platform", f"{tag}_external_id"])
    return result


def similar_above(similarities: DataFrame, minimum: float = 0.7, limit: int = 100) -> DataFrame:
    return (similarities.where(F.col("confidence_score") >= minimum)
            .orderBy(F.desc("confidence_score"), "kalshi_id", "polymarket_id").limit(limit))


def contract_query(opportunities: DataFrame, *, min_profit: float = 0.0, min_confidence: float = 0.0,
                   platforms: list[str] | None = None, categories: list[str] | None = None,
                   sort: str = "profit_margin", descending: bool = True, limit: int = 50) -> DataFrame:
    df = opportunities.where((F.col("profit_margin") >= min_profit) & (F.col("confidence_score") >= min_confidence))
    if platforms:
        df = df.where(F.col("buy_platform").isin(platforms) & F.col("sell_platform").isin(platforms))
    if categories:
        df = df.where(F.col("category").isin(categories))
    order = F.desc(sort) if descending else F.asc(sort)
    return df.orderBy(order, "opportunity_id").limit(limit)


def high_value(df: DataFrame, volume: float = 100.0, limit: int = 10) -> DataFrame:
    return df.where(F.col("volume") > volume).orderBy(F.desc("volume"), "id").limit(limit)
