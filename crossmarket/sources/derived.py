"""Market-shaped views over the star-schema, event and text tables.

Every view is a lazy DataFrame whose size follows the tables; the rules only use integer and
simple float arithmetic so that another engine can state the same view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.functions import text

AS_OF = "2001-10-15 00:00:00"

TOPICS = ("trump", "biden", "2024 election", "senate", "bitcoin", "ethereum", "crypto",
          "nfl super bowl", "nba finals", "world cup", "fed rate cut", "inflation cpi",
          "recession gdp", "nvidia", "ipo", "oscar", "movie", "hurricane", "temperature", "spacex",
          "openai gpt", "china", "ukraine", "holiday")
CATEGORY_BY_TYPE = {"ECONOMY": "Economics", "SMALL": "Sports", "MEDIUM": "Entertainment",
                    "LARGE": "Politics", "PROMO": "Crypto", "STANDARD": "Technology"}
EVALUATION_OFFSETS = tuple(1 + 48 * j for j in range(5))
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def every(k: int) -> Column:
    return F.col("n") % k == 0


def markets(spark: SparkSession, root: str) -> DataFrame:
    """Unified listings: one row per part, priced and dated from its line items."""
    sold = table(spark, root, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("q"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("x"),
        F.min("l_shipdate").alias("o"), F.max("l_shipdate").alias("e"))
    part = table(spark, root, "part")
    n = F.col("p_partkey")
    cents = (n * 37) % 101
    base = F.col("q") * (1 + n % 13)
    volume = (F.when(n % 53 == 0, F.lit(0.0)).when(n % 17 == 0, base * 0.05).otherwise(base))
    topic = F.element_at(text.string_array(TOPICS), (F.floor(n / 2) % 24 + 1).cast("int"))
    category = F.element_at(
        F.create_map(*[F.lit(v) for kv in CATEGORY_BY_TYPE.items() for v in kv]), F.col("p_type"))
    title = F.concat(F.lit("Will "), topic, F.lit(" "), F.col("p_name"), F.lit(" resolve yes"))
    close = F.col("e") + F.make_dt_interval((n % 40).cast("int"))
    platform = F.when(n % 2 == 0, "kalshi").otherwise("polymarket")
    # The join is on the key of the aggregate, so it needs no broadcast; the driver would gather the parts for one.
    return (part.hint("merge").join(sold, part.p_partkey == sold.l_partkey).select(
        n.alias("n"), platform.alias("platform"), n.cast("string").alias("external_id"),
        F.concat_ws("-", platform, n.cast("string")).alias("id"),
        F.col("p_brand").alias("event_id"), title.alias("title"),
        F.concat_ws(" ", F.col("p_brand"), F.lower("p_type")).alias("description"),
        category.alias("category"), (cents / 100.0).alias("yes_price"),
        ((100 - cents) / 100.0).alias("no_price"), volume.alias("volume"),
        (F.col("x") / 10000.0).alias("liquidity"), (n % 50).alias("open_interest"),
        F.col("o").alias("open_time"), close.alias("close_time"),
        (close > as_of()).alias("is_active"),
        F.when(close > as_of(), "active").otherwise("closed").alias("status"),
        text.normalized_title(title).alias("title_normalized"),
        text.title_prefix_hash(title).alias("title_hash")))


def unified(spark: SparkSession, root: str) -> DataFrame:
    """Listings with lowercase categories, some of them unclassified."""
    df = markets(spark, root)
    return df.withColumn("category", F.when(every(5), "other").otherwise(F.lower("category")))


def venue(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("platform") == name)


def evaluations(spark: SparkSession, root: str) -> DataFrame:
    """Equivalence evaluations of neighbouring listings on the same topic."""
    part = table(spark, root, "part").select(F.col("p_partkey").alias("n"))
    left = part.where(F.col("n") % 2 == 0).select(
        F.col("n").alias("k"),
        F.explode(F.transform(F.array(*[F.lit(o) for o in EVALUATION_OFFSETS]),
                              lambda o: o + F.col("n"))).alias("p"))
    k, p = F.col("k"), F.col("p")
    score = ((k * 31 + p * 17) % 101) / 100.0
    right = part.select(F.col("n").alias("p"))
    return left.join(right, "p").select(
        k.alias("k"), p.alias("p"), F.concat(F.lit("kalshi-"), k).alias("kalshi_id"),
        F.concat(F.lit("polymarket-"), p).alias("polymarket_id"), score.alias("confidence_score"),
        F.concat(F.lit("score "), (k * 31 + p * 17) % 101).alias("reasoning"),
        (score >= 0.7).alias("is_equivalent"),
        F.when((k + p) % 3 == 0, "screening").otherwise("deep_analysis").alias("stage"),
        (as_of() - F.make_dt_interval(F.lit(0), ((k + p) % 72).cast("int"))).alias("evaluated_at"))


def price_history(spark: SparkSession, root: str) -> DataFrame:
    ev = table(spark, root, "events")
    return ev.select(
        F.col("event_id"), F.col("user_id").cast("string").alias("market_id"),
        F.col("event_type").alias("outcome"),
        ((F.floor(F.col("value") * 100) % 98 + 1) / 100.0).alias("price"),
        F.col("value").alias("volume"), F.col("ts").alias("timestamp"))


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """Stage executions, one per order."""
    o = table(spark, root, "orders")
    whole = F.floor("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("stage"),
        F.when(F.col("o_custkey") % 2 == 0, "kalshi").otherwise("polymarket").alias("platform"),
        F.col("o_orderdate").alias("started_at"), (whole % 5000).alias("processing_time_ms"),
        F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(whole).alias("input_count"),
        (whole % 1000).alias("output_count"),
        F.when(F.col("o_orderstatus") == "F", "success").when(
            F.col("o_orderstatus") == "P", "partial").otherwise("error").alias("status"),
        (F.col("o_orderkey") % 3).alias("error_count"),
        F.when(F.col("o_orderkey") % 7 == 0, 500).otherwise(200).alias("api_status"))


def mixed_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings drawn towards the first of every five, in whose label they are: clusters of neighbours."""
    vectors = table(spark, root, "embeddings")
    base = vectors.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("base"), "label")
    mixed = F.zip_with("base", "embedding", lambda x, y: x.cast("double") + 0.5 * y.cast("double"))
    return (vectors.drop("label").withColumn("base_id", F.col("vec_id") - F.col("vec_id") % 5).join(base, "base_id")
            .select("vec_id", "label", mixed.alias("embedding")))


def raw_kalshi(spark: SparkSession, root: str) -> DataFrame:
    """Landing records of the first venue: mixed price units, gaps, odd states."""
    m = venue(markets(spark, root), "kalshi")
    n = F.col("n")
    cents = F.round(F.col("yes_price") * 100)
    unit = F.when(every(4), F.lit(1.0)).otherwise(F.lit(100.0))
    bid, ask = F.greatest(cents - 1, F.lit(0.0)), cents + 1
    iso = lambda c: F.date_format(c, ISO)
    return m.select(
        n, F.when(every(38), "").otherwise(F.concat(F.lit("K"), n)).alias("ticker"),
        F.when(every(94) | every(76), None).otherwise(F.concat(F.lit("k-"), n)).alias("id"),
        F.col("event_id").alias("event_ticker"),
        F.when(every(122), "").otherwise(F.col("title")).alias("title"),
        F.when(every(10), None).otherwise(F.col("description")).alias("subtitle"),
        F.when(every(26), None).when(every(22), "Elections").when(every(14), F.lower("category"))
        .otherwise(F.col("category")).alias("category"),
        F.when(every(58), "halted").when(every(34), "settled").when(n % 10 == 0, "closed")
        .when(n % 10 == 2, "initialized").when(n % 10 == 6, "open").otherwise("active").alias("status"),
        iso("open_time").alias("open_time"),
        F.when(every(62), None).otherwise(iso("close_time")).alias("close_time"),
        F.when(every(8), F.date_format("open_time", "yyyy-MM-dd HH:mm:ss"))
        .when(every(6), F.date_format("open_time", "MM/dd/yyyy"))
        .when(every(14), "garbage").otherwise(iso("open_time")).alias("created_time"),
        F.when(every(18), 0.0).otherwise(bid / unit).alias("yes_bid"),
        F.when(every(18), None).otherwise(ask / unit).alias("yes_ask"),
        (F.greatest(100 - ask, F.lit(0.0)) / unit).alias("no_bid"), ((100 - bid) / unit).alias("no_ask"),
        F.when(every(30), None).otherwise(cents / unit).alias("last_price"),
        F.when(every(6), None).otherwise(F.col("volume")).alias("volume"),
        (F.col("volume") / 10).alias("volume_24h"),
        F.when(every(44), 0.0).otherwise(F.col("liquidity")).alias("liquidity"),
        F.col("open_interest"), (n % 3 != 0).alias("can_close_early"))


def raw_polymarket(spark: SparkSession, root: str) -> DataFrame:
    """Landing records of the second venue: JSON text arrays, string numbers, gaps."""
    m = venue(markets(spark, root), "polymarket")
    n = F.col("n")
    cents = F.round(F.col("yes_price") * 100).cast("int")
    share = lambda c: c.cast("decimal(18,2)").cast("string")
    volume_text = share(F.round(F.col("volume") * 100).cast("bigint") / F.lit(100))
    iso = lambda c: F.date_format(c, ISO)
    return m.select(
        n, F.when(every(45), None).otherwise(F.concat(F.lit("P"), n)).alias("id"),
        F.concat(F.lit("c"), n).alias("conditionId"),
        F.when(every(121), None).otherwise(F.col("title")).alias("question"), F.col("title"),
        F.when(every(7), None).otherwise(F.col("description")).alias("description"),
        F.when(every(33), None).when(every(27), "other").when(every(21), "Gaming")
        .when(every(15), "Pop Culture").otherwise(F.col("category")).alias("category"),
        F.concat(F.lit("m-"), n).alias("slug"),
        F.when(every(49), None).when(every(35), "not json").when(every(55), '["A","B","C","D","E"]')
        .when(every(39), '["Only"]').when(every(25), '["Up","Down"]')
        .when(every(9), '["YES","No","Maybe"]').otherwise('["Yes","No"]').alias("outcomes"),
        F.when(every(51), F.concat(F.lit('["'), share(cents / 100), F.lit('"]')))
        .otherwise(F.concat(F.lit('["'), share(cents / 100), F.lit('","'), share((100 - cents) / 100),
                            F.lit('"]'))).alias("outcomePrices"),
        F.when(every(57), None).otherwise(
            F.concat(F.lit('["t'), n, F.lit('a","t'), n, F.lit('b"]'))).alias("clobTokenIds"),
        F.when(every(5), None).otherwise(F.col("yes_price")).alias("lastTradePrice"),
        F.when(every(65), None).otherwise(F.greatest(cents - 2, F.lit(0)) / 100.0).alias("bestBid"),
        F.when(every(65), None).otherwise((cents + 2) / 100.0).alias("bestAsk"),
        F.when(every(77), "abc").when(every(7), F.concat(F.lit("$"), volume_text))
        .otherwise(volume_text).alias("volume"),
        F.when(every(11), None).otherwise(F.col("volume")).alias("volumeNum"),
        F.col("liquidity").alias("liquidityNum"),
        iso("open_time").alias("startDate"), iso("open_time").alias("createdAt"),
        F.when(every(63), None).when(every(69), "someday").otherwise(iso("close_time")).alias("endDate"),
        (n % 3 != 0).alias("active"), every(13).alias("closed"), every(19).alias("archived"),
        F.when(every(17), None).when(n % 4 == 1, '["alpha","beta"]').otherwise("plain").alias("tags"))


def stream_messages(spark: SparkSession, root: str) -> DataFrame:
    """Message bus payloads as (key, value) text, one per event; some malformed or unknown."""
    ev = table(spark, root, "events")
    return ev.select(F.col("event_id").cast("string").alias("key"), message_value().alias("value"),
                     F.col("ts"))


def message_value() -> Column:
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    pick = lambda names, i: F.element_at(text.string_array(names), (i + 1).cast("int"))
    price = (F.floor(v * 100) % 98 + 1) / 100.0
    platform = F.when(u % 2 == 0, "kalshi").otherwise("polymarket")
    envelope = [F.concat(F.lit("m"), e).alias("message_id"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                F.lit("1.0").alias("version"), F.lit("demo").alias("source")]

    def body(kind: str, *fields: Column) -> Column:
        return F.to_json(F.struct(*envelope, F.lit(kind).alias("message_type"), *fields))

    update = body(
        "market_update", platform.alias("platform"), u.cast("string").alias("external_id"),
        pick(("new", "price_change", "volume_change", "status_change"), e % 4).alias("update_type"),
        F.struct((((e % 97) + 1) / 100.0).alias("price")).alias("old_values"),
        F.struct(price.alias("price")).alias("new_values"),
        F.struct(F.concat(F.lit("Market "), u).alias("title"), v.alias("volume")).alias("current_market"))
    opportunity = body(
        "arbitrage_opportunity", F.concat(F.lit("opp-"), u % 200).alias("opportunity_id"),
        pick(("detected", "updated", "expired", "executed"), (e % 7) % 4).alias("action"),
        F.concat(F.lit("K"), u).alias("market1_title"), F.concat(F.lit("P"), u).alias("market2_title"),
        v.alias("expected_profit_usd"), ((e % 30) / 100.0).alias("expected_profit_percentage"),
        ((e % 101) / 100.0).alias("confidence_score"),
        pick(("low", "medium", "high"), e % 3).alias("risk_level"),
        ((e % 1000) / 1000.0).alias("priority_score"))
    metrics = body(
        "pipeline_metrics", F.concat(F.lit("run-"), u % 50).alias("execution_id"),
        pick(("extract", "normalize", "bucket", "filter", "evaluate"), e % 5).alias("stage"),
        F.lit("completed").alias("status"), (e % 500).alias("input_count"),
        (e % 200).alias("output_count"), v.alias("processing_time_seconds"),
        ((80 + e % 21) / 100.0).alias("success_rate"), (e % 4).alias("error_count"))
    alert = body(
        "alert", F.concat(F.lit("a"), e).alias("alert_id"),
        pick(("high_profit_opportunity", "pipeline_failure", "data_quality_issue"), e % 3).alias("alert_type"),
        pick(("low", "medium", "high", "critical"), e % 4).alias("severity"),
        F.concat(F.lit("Alert "), e).alias("title"), F.lit("details").alias("description"))
    kind = F.col("event_type")
    return (F.when(e % 97 == 0, F.lit("{broken")).when(kind == "view", update)
            .when(kind == "purchase", opportunity).when(kind == "click", metrics)
            .when(kind == "error", alert).otherwise(body("user_joined")))
