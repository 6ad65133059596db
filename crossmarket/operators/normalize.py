"""Venue payloads to common rows. Each function is one select over landing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.config import NormalizationConfig
from crossmarket.functions import categories, dates, outcomes, prices, text

CFG = NormalizationConfig()


def present(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a NULL of its type where a payload variant lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _common(platform: str, external_id: Column, title: Column, description: Column, category: Column,
            outcome_array: Column, volume: Column, status: Column, created: Column, end: Column,
            as_of: str) -> list[Column]:
    clean_title = text.clean_text(title, CFG.max_title_length)
    name = categories.normalized(category, clean_title, platform, CFG.category_confidence)
    return [external_id.alias("external_id"), F.lit(platform).alias("platform"), clean_title.alias("title"),
            text.clean_text(description, CFG.max_description_length).alias("description"),
            name.alias("category"), outcome_array.alias("outcomes"),
            categories.event_type(clean_title, name).alias("event_type"), status.alias("status"),
            volume.alias("volume"), outcomes.liquidity(outcome_array, volume).alias("liquidity"),
            created.alias("created_date"), end.alias("end_date"),
            dates.as_timestamp(as_of).alias("normalized_at")]


def kalshi(df: DataFrame, as_of: str) -> DataFrame:
    """Pipeline variant: bid (else ask, else even) prices Yes, No is the complement."""
    quote = F.coalesce(present(df, "yes_bid", "double"), present(df, "yes_ask", "double"), F.lit(0.5))
    sides = outcomes.yes_no(prices.normalize_price(quote, numeric=True),
                            prices.normalize_volume(present(df, "yes_volume", "double"), numeric=True),
                            prices.normalize_volume(present(df, "no_volume", "double"), numeric=True))
    created = dates.parse_date(F.col("open_time"), as_of)
    end = dates.parse_date(F.col("close_time"), as_of)
    status = categories.kalshi_status(F.col("status"), end, dates.as_timestamp(as_of))
    return df.select(*_common(
        "kalshi", F.coalesce("id", "ticker", F.lit("")), F.col("title"), F.col("subtitle"), F.col("category"),
        sides, prices.normalize_volume(F.col("volume"), numeric=True), status, created, end, as_of))


def polymarket(df: DataFrame, as_of: str) -> DataFrame:
    """Pipeline variant: explicit outcome objects, else a binary pair from the price field."""
    volume = prices.normalize_volume(F.coalesce(F.col("volume"), present(df, "volumeUSD")))
    sides = outcomes.yes_no(prices.normalize_price(present(df, "price", "double"), numeric=True), volume,
                            F.lit("0").cast("decimal(18,2)"))
    if "outcome_objects" in df.columns:
        sides = F.coalesce(outcomes.listed(F.col("outcome_objects")), sides)
    created = dates.parse_date(F.col("createdAt"), as_of)
    end = dates.parse_date(F.coalesce("endDate", present(df, "resolutionDate")), as_of)
    status = categories.polymarket_status(F.col("closed"), F.col("active"), end, dates.as_timestamp(as_of))
    return df.select(*_common(
        "polymarket", F.coalesce("id", "conditionId", F.lit("")), F.coalesce("question", "title"),
        F.col("description"), F.col("category"), sides,
        volume, status, created, end, as_of))


def dispatch(envelopes: DataFrame, as_of: str, schemas: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(normalized, rejected): parse each platform's payload with its schema and normalize it.

    Rejected are unsupported platforms and payloads without a readable identity and title.
    """
    parts, reasons = [], []
    for platform, normalizer in (("kalshi", kalshi), ("polymarket", polymarket)):
        mine = envelopes.where(F.col("platform") == platform).withColumn(
            "_p", F.from_json("raw_data", schemas[platform]))
        readable = F.coalesce(F.size(F.json_object_keys("raw_data")), F.lit(-1)) > 0
        parts.append(normalizer(mine.where(readable).select("_p.*"), as_of))
        reasons.append(mine.where(~readable).select("id", "platform", F.lit("unreadable").alias("reason")))
    unknown = envelopes.where(~F.coalesce(F.col("platform").isin("kalshi", "polymarket"), F.lit(False))).select(
        "id", "platform", F.lit("unsupported").alias("reason"))
    return parts[0].unionByName(parts[1]), reasons[0].unionByName(reasons[1]).unionByName(unknown)


def kalshi_extracted(df: DataFrame) -> DataFrame:
    """Extractor variant: ask prices, volume = liquidity / 1000."""
    yes = prices.asked_price(F.col("yes_ask"), present(df, "yes_price", "double"), F.col("last_price"))
    no = prices.asked_no_price(F.col("no_ask"), present(df, "no_price", "double"), F.col("yes_ask"),
                               present(df, "yes_price", "double"))
    title = F.coalesce("title", F.lit("Untitled Market"))
    category = categories.standardize(F.col("category"), "kalshi")
    liquidity = F.coalesce("liquidity", F.lit(0.0))
    return df.select(
        filled(F.col("ticker"), F.col("id")).alias("external_id"), F.lit("kalshi").alias("platform"),
        title.alias("title"), filled(F.col("subtitle"), present(df, "description"), title).alias("description"),
        category.alias("category"), F.array(F.lower(category)).alias("tags"), yes.alias("yes_price"),
        no.alias("no_price"), dates.parse_iso(F.col("created_time")).alias("created_date"),
        dates.parse_iso(F.col("close_time")).alias("end_date"), (liquidity / 1000).alias("volume"),
        liquidity.alias("liquidity"), F.lit(True).alias("is_active"))


def polymarket_extracted(df: DataFrame, as_of: str) -> DataFrame:
    """Extractor variant: last trade or midpoint; missing end dates are one year ahead."""
    yes = prices.traded_price(F.col("lastTradePrice"), F.col("bestBid"), F.col("bestAsk"))
    quoted = F.coalesce(F.col("lastTradePrice"), (F.col("bestBid") + F.col("bestAsk")) / 2, F.lit(0.5))
    named = outcomes.two_names(F.col("outcomes"))
    title = F.coalesce("question", F.lit("Untitled Market"))
    category = categories.standardize(F.col("category"), "polymarket")
    # The Java date parser is lenient about JSON in quotes, so test for an array first.
    tag_list = F.when(F.col("tags").startswith("["), F.from_json("tags", "array<string>"))
    tags = F.when(F.col("tags").isNull(), F.array(F.lower(category))).otherwise(
        F.coalesce(tag_list, F.array("tags")))
    return df.select(
        F.col("id").alias("external_id"), F.lit("polymarket").alias("platform"), title.alias("title"),
        filled(F.col("description"), title).alias("description"), category.alias("category"), tags.alias("tags"),
        named[0].alias("first_outcome"), named[1].alias("second_outcome"), yes.alias("yes_price"),
        prices.clamp(1.0 - quoted, 0.0, 1.0).alias("no_price"),
        dates.parse_iso(F.col("startDate")).alias("created_date"),
        dates.parse_iso(F.col("endDate"), F.add_months(dates.as_timestamp(as_of), 12).cast("timestamp"))
        .alias("end_date"),
        F.coalesce(prices.digits(F.col("volume")).try_cast("double"), F.lit(0.0)).alias("volume"),
        F.coalesce("liquidityNum", F.lit(0.0)).alias("liquidity"), F.lit(True).alias("is_active"))


def kalshi_populated(df: DataFrame) -> DataFrame:
    """Flat row of the populate job: categorized by title, midpoint price, volume proxy."""
    title = filled(F.col("title"), F.lit("Untitled Market"))
    price = lambda s: prices.quoted_price(F.col(f"{s}_bid"), F.col(f"{s}_ask"), F.col("last_price"), s,
                                          one_sided=True)
    liquidity = F.coalesce("liquidity", F.lit(0.0))
    return df.select(
        F.lit("kalshi").alias("platform"), F.col("ticker").alias("external_id"), title.alias("title"),
        filled(F.col("subtitle"), title).alias("description"),
        categories.from_title(title, "populate").alias("category"), price("yes").alias("yes_price"),
        price("no").alias("no_price"), (liquidity / 1000).alias("volume"),
        F.coalesce(prices.positive(liquidity), F.col("open_interest").cast("double"), F.lit(0.0)).alias("liquidity"),
        F.col("close_time").alias("end_date"), F.lit(True).alias("is_active"))


def polymarket_populated(df: DataFrame) -> DataFrame:
    """Flat row of the populate job; multi-outcome listings without yes/no are dropped."""
    yes = prices.lenient_traded_price(F.col("lastTradePrice"), F.col("bestBid"), F.col("bestAsk"))
    volume = F.coalesce(prices.positive(F.col("volumeNum")), prices.digits(F.col("volume")).try_cast("double"),
                        F.lit(0.0))
    kept = df.where(F.col("id").isNotNull() & F.col("question").isNotNull() & outcomes.names(F.col("outcomes")).isNotNull()
                    & outcomes.is_yes_no_or_small(F.col("outcomes")))
    return kept.select(
        F.lit("polymarket").alias("platform"), F.col("id").alias("external_id"), F.col("question").alias("title"),
        filled(F.col("description"), F.col("question")).alias("description"),
        F.coalesce(F.lower("category"), F.lit("other")).alias("category"), yes.alias("yes_price"),
        (1.0 - yes).alias("no_price"), volume.alias("volume"),
        F.coalesce("liquidityNum", F.lit(0.0)).alias("liquidity"), F.col("endDate").alias("end_date"),
        (F.col("active") & ~F.coalesce("archived", F.lit(False))).alias("is_active"))


def _titles(df: DataFrame) -> DataFrame:
    return df.withColumn("title_normalized", text.normalized_title(F.col("title"))).withColumn(
        "title_hash", F.substring("title_normalized", 1, 20))


def kalshi_unified(df: DataFrame) -> DataFrame:
    """Collected listings (ticker, prices, volume, ...) to unified rows."""
    rows = df.where(F.col("ticker").isNotNull()).select(
        F.concat_ws("-", F.lit("kalshi"), "ticker").alias("id"), F.lit("kalshi").alias("platform"),
        F.col("ticker").alias("external_id"), F.coalesce("event_ticker", F.lit("")).alias("event_id"), "title",
        F.coalesce("title", F.lit("")).alias("description"),
        categories.standardize(F.col("category"), "unified").alias("category"),
        prices.or_default(F.col("yes_price"), 0.5).alias("yes_price"),
        prices.or_default(F.col("no_price"), 0.5).alias("no_price"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"),
        F.coalesce("open_interest", F.lit(0)).cast("int").alias("open_interest"), "status", "is_active",
        F.col("is_active").alias("can_trade"), "close_time")
    return _titles(rows)


def polymarket_unified(df: DataFrame) -> DataFrame:
    """Flat raw rows to unified rows; a longer description inside the payload wins."""
    given = F.coalesce("description", F.lit(""))
    inside = F.get_json_object("raw_data", "$.description")
    rows = df.where(F.col("external_id").isNotNull()).select(
        F.concat_ws("-", F.lit("polymarket"), "external_id").alias("id"), F.lit("polymarket").alias("platform"),
        "external_id", F.lit("").alias("event_id"), "title",
        F.when(F.length(inside) > F.length(given), inside).otherwise(given).alias("description"),
        categories.standardize(F.col("category"), "unified").alias("category"),
        prices.or_default(F.col("yes_price"), 0.5).alias("yes_price"),
        prices.or_default(F.col("no_price"), 0.5).alias("no_price"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"),
        F.lit(0).alias("open_interest"), F.lit("active").alias("status"), F.lit(True).alias("is_active"),
        F.lit(True).alias("can_trade"), "close_time")
    return _titles(rows)


def backend_kalshi(df: DataFrame) -> DataFrame:
    """Backend variant: ask-priced outcomes with ids, listing URL, open means active."""
    return df.select(
        F.col("ticker").alias("external_id"), "title", F.coalesce("subtitle", F.lit("")).alias("description"),
        "category", outcomes.asks(F.col("ticker"), F.col("yes_ask"), F.col("no_ask"), present(df, "volume_total")
                                  .cast("double")).alias("outcomes"),
        F.when(F.col("status") == "open", "active").otherwise("closed").alias("status"),
        F.concat(F.lit("https://kalshi.com/markets/"), "ticker").alias("url"))


def backend_polymarket(df: DataFrame) -> DataFrame:
    """Backend variant: outcomes zipped from three JSON arrays, event URL."""
    return df.select(
        F.col("id").alias("external_id"), F.col("question").alias("title"), "description", "category",
        outcomes.zipped(F.col("outcomes"), F.col("outcomePrices"), F.col("clobTokenIds")).alias("outcomes"),
        categories.backend_status(F.col("closed"), F.col("active")).alias("status"),
        F.when(F.col("slug").isNotNull(), F.concat(F.lit("https://polymarket.com/event/"), "slug")).alias("url"))


def stream_payload(df: DataFrame) -> Column:
    """JSON text of a normalized market for the message bus."""
    as_double = lambda c: F.col(c).cast("double").alias(c)
    sides = F.transform("outcomes", lambda o: F.struct(
        o["name"].alias("name"), o["price"].cast("double").alias("price"),
        o["volume"].cast("double").alias("volume"), o["probability"].alias("probability")))
    return F.to_json(F.struct(
        "platform", "external_id", "title", "category", as_double("volume"), as_double("liquidity"),
        sides.alias("outcomes"), F.date_format("end_date", "yyyy-MM-dd'T'HH:mm:ss").alias("end_date"), "status"))


def normalization_stats(envelopes: DataFrame, normalized: DataFrame) -> DataFrame:
    """Processed, successful and failed counts with rates."""
    total = envelopes.agg(F.count(F.lit(1)).alias("total_processed")).withColumn("_j", F.lit(1))
    done = normalized.agg(F.count(F.lit(1)).alias("successful")).withColumn("_j", F.lit(1))
    rate = F.coalesce(F.try_divide("successful", "total_processed"), F.lit(0.0))
    return total.join(done, "_j").select(
        "total_processed", "successful", (F.col("total_processed") - F.col("successful")).alias("failed"),
        rate.alias("success_rate"), (1 - rate).alias("failure_rate"))
