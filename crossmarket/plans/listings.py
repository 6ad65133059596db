"""Registered queries: scans, envelopes, normalization and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.functions import categories, dates, outcomes, prices, replies, text, vocab
from crossmarket.operators import browse, normalize, tables
from crossmarket.plans import sqltext as sq
from crossmarket.plans.oracle_views import T, has_any, hits, quoted
from crossmarket.plans.registry import query
from crossmarket.sources import derived, landing, sinks
from crossmarket.sources.derived import AS_OF

AS_OF_ISO = AS_OF.replace(" ", "T") + "Z"


def kalshi_records(spark: SparkSession, root: str) -> DataFrame:
    return derived.raw_kalshi(spark, root).drop("n")


def polymarket_records(spark: SparkSession, root: str) -> DataFrame:
    return derived.raw_polymarket(spark, root).drop("n")


def kalshi_envelopes(spark: SparkSession, root: str) -> DataFrame:
    return landing.envelope(kalshi_records(spark, root), "kalshi", landing.kalshi_key(), AS_OF)


def polymarket_envelopes(spark: SparkSession, root: str) -> DataFrame:
    return landing.envelope(polymarket_records(spark, root), "polymarket", landing.polymarket_key(), AS_OF)


def response_pages(records: DataFrame, size: int = 100) -> DataFrame:
    """Response texts of up to `size` ids, wrapped in the five accepted ways."""
    rows = records.withColumn("page_no", F.floor(F.col("n") / size)).groupBy("page_no").agg(
        F.collect_list(F.struct(*[c for c in records.columns if c != "n"])).alias("rows"))
    kinds = [F.to_json(F.struct(F.col("rows").alias(w))) for w in landing.WRAPPERS] + [F.to_json("rows")]
    return rows.select(F.element_at(F.array(*kinds), (F.col("page_no") % 5 + 1).cast("int")).alias("page"))


# --- scans and sinks -------------------------------------------------------------------------

@query("a1_kalshi_envelopes", """
    SELECT coalesce(nullif(ticker, ''), id) AS external_id, 'kalshi' AS platform, title, yes_bid, volume,
           'pending' AS processing_status
    FROM raw_kalshi WHERE coalesce(nullif(ticker, ''), id) IS NOT NULL""")
def _(spark, root):
    parsed = kalshi_envelopes(spark, root).withColumn("p", F.from_json("raw_data", landing.KALSHI_PAYLOAD))
    return parsed.select("external_id", "platform", "p.title", "p.yes_bid", "p.volume", "processing_status")


@query("a2_polymarket_pages", """
    SELECT id AS external_id, 'polymarket' AS platform, question, lastTradePrice AS last_trade
    FROM raw_polymarket WHERE id IS NOT NULL""")
def _(spark, root):
    pages = response_pages(derived.raw_polymarket(spark, root))
    envelopes = landing.envelope(landing.unwrap(pages, landing.POLYMARKET_PAYLOAD), "polymarket",
                                 landing.polymarket_key(), AS_OF)
    parsed = envelopes.withColumn("p", F.from_json("raw_data", landing.POLYMARKET_PAYLOAD))
    return parsed.select("external_id", "platform", "p.question", F.col("p.lastTradePrice").alias("last_trade"))


@query("a3_unwrapped_responses", "SELECT ticker, id, title, status FROM raw_kalshi")
def _(spark, root):
    pages = response_pages(derived.raw_kalshi(spark, root))
    return landing.unwrap(pages, landing.KALSHI_PAYLOAD).select("ticker", "id", "title", "status")


@query("a4_event_category_load", """
    SELECT m.n, m.event_id AS event_ticker, e.category
    FROM markets m JOIN (SELECT event_id, min(category) AS category FROM markets GROUP BY 1) e USING (event_id)""")
def _(spark, root):
    m = derived.markets(spark, root).withColumnRenamed("event_id", "event_ticker")
    events = m.groupBy("event_ticker").agg(F.min("category").alias("category"))
    return landing.with_event_category(m.select("n", "event_ticker", "category"), events).select(
        "n", "event_ticker", "category")


@query("a5_typed_quotes", """
    SELECT ticker, coalesce(volume, 0) AS volume, coalesce(yes_ask, 0) AS yes_ask, yes_bid,
           coalesce(last_price, 0) AS last_price, liquidity, open_interest, can_close_early FROM raw_kalshi""")
def _(spark, root):
    raw = kalshi_records(spark, root)
    words = raw.withColumns({c: F.col(c).cast("string") for c in (
        "volume", "volume_24h", "yes_bid", "yes_ask", "no_bid", "no_ask", "last_price", "liquidity", "open_interest")})
    return landing.typed_quotes(words).select("ticker", "volume", "yes_ask", "yes_bid", "last_price", "liquidity",
                                              "open_interest", "can_close_early")


def json_sql(fields: dict[str, str]) -> str:
    """A JSON object as text: the fields in order, missing ones left out."""
    parts = " || ".join(f"coalesce(',\"{name}\":' || to_json({value})::VARCHAR, '')" for name, value in fields.items())
    return f"'{{' || substring({parts}, 2) || '}}'"


ISO_SQL = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
SAME = lambda names: {c: f"r.{c}" for c in names.split()}
MONEY = "printf('%.2f', round(m.volume * 100) / 100)"
RAW_KALSHI_JSON = json_sql({
    **SAME("ticker id event_ticker title subtitle category status open_time close_time"),
    "created_time": f"""CASE WHEN n % 8 = 0 THEN strftime(r.open_ts, '%Y-%m-%d %H:%M:%S') WHEN n % 6 = 0 THEN strftime(r.open_ts, '%m/%d/%Y')
        WHEN n % 14 = 0 THEN 'garbage' ELSE {ISO_SQL('r.open_ts')} END""",
    **SAME("yes_bid yes_ask no_bid no_ask last_price volume volume_24h liquidity open_interest can_close_early")})
RAW_POLYMARKET_JSON = json_sql({
    **SAME("id conditionId question title description category slug outcomes"),
    "outcomePrices": """CASE WHEN n % 51 = 0 THEN printf('["%.2f"]', r.cents / 100.0::DOUBLE)
        ELSE printf('["%.2f","%.2f"]', r.cents / 100.0::DOUBLE, (100 - r.cents) / 100.0::DOUBLE) END""",
    "clobTokenIds": """CASE WHEN n % 57 <> 0 THEN '["t' || n || 'a","t' || n || 'b"]' END""",
    **SAME("lastTradePrice bestBid bestAsk"),
    "volume": f"CASE WHEN n % 77 = 0 THEN 'abc' WHEN n % 7 = 0 THEN '$' || {MONEY} ELSE {MONEY} END",
    **SAME("volumeNum liquidityNum"), "startDate": ISO_SQL("m.open_time"), "createdAt": ISO_SQL("m.open_time"),
    "endDate": f"CASE WHEN n % 63 = 0 THEN NULL WHEN n % 69 = 0 THEN 'someday' ELSE {ISO_SQL('m.close_time')} END",
    **SAME("active closed archived"),
    "tags": """CASE WHEN n % 17 = 0 THEN NULL WHEN n % 4 = 1 THEN '["alpha","beta"]' ELSE 'plain' END"""})


@query("a6_raw_table_rows", f"""
    SELECT 'kalshi' AS platform, coalesce(nullif(r.ticker, ''), r.id) AS external_id, {RAW_KALSHI_JSON} AS raw_data, true AS own_id,
           'pending' AS processing_status
    FROM raw_kalshi r JOIN markets m USING (n) WHERE coalesce(nullif(r.ticker, ''), r.id) IS NOT NULL
    UNION ALL SELECT 'polymarket', r.id, {RAW_POLYMARKET_JSON}, true, 'pending'
    FROM raw_polymarket r JOIN markets m USING (n) WHERE r.id IS NOT NULL""")
def _(spark, root):
    """Whole envelopes; of the random id only its form can be checked."""
    both = kalshi_envelopes(spark, root).unionByName(polymarket_envelopes(spark, root)).withColumn("id", F.expr("uuid()"))
    return both.select("platform", "external_id", "raw_data", (F.length("id") == 36).alias("own_id"), "processing_status")


@query("a7_normalized_rows", """
    SELECT 'kalshi-' || coalesce(id, ticker, '') AS id, title, 'Yes' AS first_name, 2 AS outcome_count
    FROM raw_kalshi""")
def _(spark, root):
    rows = sinks.normalized_rows(normalize.kalshi(kalshi_records(spark, root), AS_OF))
    names = F.from_json("outcomes", "array<struct<name:string>>")
    return rows.select("id", "title", names[0]["name"].alias("first_name"), F.size(names).alias("outcome_count"))


@query("a9_insert_or_ignore", "SELECT id, title, volume FROM markets WHERE NOT is_active")
def _(spark, root):
    m = derived.markets(spark, root).select("id", "title", "volume", "is_active")
    target, source = m.where("is_active").drop("is_active"), m.drop("is_active")
    return tables.insert_or_ignore(target, source.unionByName(source), ["id"])


@query("a10_insert_or_replace", """
    SELECT id, platform, CASE WHEN is_active THEN volume + 2 ELSE volume END AS volume FROM markets""")
def _(spark, root):
    m = derived.markets(spark, root)
    target = m.select("id", "platform", "volume", F.lit(0).alias("version"))
    batch = [m.where("is_active").select("id", "platform", (F.col("volume") + v).alias("volume"),
                                         F.lit(v).alias("version")) for v in (1, 2)]
    return tables.insert_or_replace(target, batch[0].unionByName(batch[1]), ["id"], ["version"]).drop("version")


@query("a11_sample_rows", """
    SELECT id, title, yes_price FROM markets ORDER BY md5('7|' || id || '|' || title || '|' || CAST(yes_price AS VARCHAR)) LIMIT 20""")
def _(spark, root):
    return sinks.sample_rows(derived.markets(spark, root).select("id", "title", "yes_price"), 20, seed=7)


@query("a12_table_counts", """
    SELECT 'markets' AS table_name, count(*) AS row_count FROM part
    UNION ALL SELECT 'price_history', count(*) FROM events
    UNION ALL SELECT 'run_logs', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents""")
def _(spark, root):
    return sinks.table_counts({"markets": derived.table(spark, root, "part"),
                               "price_history": derived.table(spark, root, "events"),
                               "run_logs": derived.table(spark, root, "orders"),
                               "documents": derived.table(spark, root, "documents")})


@query("a13_run_log_status", """
    SELECT CASE WHEN error_count = 0 THEN 'success' WHEN output_count > 0 THEN 'partial' ELSE 'error' END
           AS derived_status, count(*) AS runs FROM run_logs GROUP BY 1""")
def _(spark, root):
    status = sinks.run_status(F.col("output_count"), F.col("error_count"))
    return derived.run_logs(spark, root).groupBy(status.alias("derived_status")).agg(F.count(F.lit(1)).alias("runs"))


# --- normalization ---------------------------------------------------------------------------

RANGE = f"BETWEEN {T} - to_days(365) AND {T} + to_days(1095)"
IN_RANGE = lambda c: f"CASE WHEN {c} {RANGE} THEN {c} END"
K_NAME = sq.normalized_category("category", "title", "kalshi")
P_NAME = sq.normalized_category("category", "coalesce(question, title)", "polymarket")
K_STATUS = f"""CASE WHEN status IN ('open', 'active') THEN 'active' WHEN status IN ('closed', 'settled') THEN 'closed'
    WHEN status IN ('suspended', 'halted') THEN 'suspended'
    WHEN {IN_RANGE('close_ts')} < {T} THEN 'closed' ELSE 'active' END"""
P_STATUS = f"""CASE WHEN closed THEN 'closed' WHEN active THEN 'active'
    WHEN {IN_RANGE('end_ts')} < {T} THEN 'closed' ELSE 'active' END"""
HALF_EVEN = "(c // 2 + CASE WHEN c % 2 = 1 AND (c // 2) % 2 = 1 THEN 1 ELSE 0 END) / 100.0::DOUBLE"
K_QUOTE = "least(greatest(yes_bid, 0.0001::DOUBLE), 0.9999::DOUBLE)"


@query("b1_normalize_kalshi", f"""
    SELECT coalesce(id, ticker, '') AS external_id, title, coalesce(subtitle, '') AS description,
           {K_NAME} AS category, {sq.event_type('title', f'({K_NAME})')} AS event_type, {K_STATUS} AS status,
           coalesce(volume, 0) AS volume, 0.0::DOUBLE AS liquidity, {K_QUOTE} AS yes_price,
           1 - {K_QUOTE} AS no_price, {IN_RANGE('open_ts')} AS created_date, {IN_RANGE('close_ts')} AS end_date
    FROM raw_kalshi""", r="volume yes_price no_price")
def _(spark, root):
    return flat_normalized(normalize.kalshi(kalshi_records(spark, root), AS_OF))


def flat_normalized(df: DataFrame) -> DataFrame:
    return df.select("external_id", "title", "description", "category", "event_type", "status", "volume", "liquidity",
                     F.col("outcomes")[0]["price"].alias("yes_price"), F.col("outcomes")[1]["price"].alias("no_price"),
                     "created_date", "end_date")


@query("b2_normalize_polymarket", f"""
    SELECT coalesce(id, conditionId, '') AS external_id, title,
           coalesce(description, '') AS description, {P_NAME} AS category,
           {sq.event_type('title', f'({P_NAME})')} AS event_type, {P_STATUS} AS status, c / 100.0::DOUBLE AS volume,
           {HALF_EVEN} AS liquidity, 0.5::DOUBLE AS yes_price, 0.5::DOUBLE AS no_price,
           {IN_RANGE('start_ts')} AS created_date, {IN_RANGE('end_ts')} AS end_date
    FROM (SELECT *, CAST(round(coalesce(volume_digits, 0) * 100) AS BIGINT) AS c FROM raw_polymarket)""")
def _(spark, root):
    return flat_normalized(normalize.polymarket(polymarket_records(spark, root), AS_OF))


def mixed_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """Envelopes of both venues, one unsupported platform and some broken payloads."""
    both = kalshi_envelopes(spark, root).unionByName(polymarket_envelopes(spark, root))
    other = both.withColumn("platform", F.when(F.col("external_id").endswith("7"), "manifold").otherwise(F.col("platform")))
    broken = F.when(F.col("external_id").endswith("5"), F.lit("{broken")).otherwise(F.col("raw_data"))
    return other.withColumn("raw_data", broken).withColumn("id", F.col("external_id"))


MIXED = """SELECT coalesce(nullif(ticker, ''), id) AS external_id, 'kalshi' AS platform FROM raw_kalshi
           WHERE coalesce(nullif(ticker, ''), id) IS NOT NULL
           UNION ALL SELECT id, 'polymarket' FROM raw_polymarket WHERE id IS NOT NULL"""


@query("b3_dispatch_outcomes", """
    SELECT CASE WHEN external_id LIKE '%7' THEN 'manifold' ELSE platform END AS platform,
           CASE WHEN external_id LIKE '%7' THEN 'unsupported' WHEN external_id LIKE '%5' THEN 'unreadable'
                ELSE 'normalized' END AS reason, count(*) AS records
    FROM mixed GROUP BY 1, 2""", views={"mixed": MIXED})
def _(spark, root):
    done, rejected = normalize.dispatch(mixed_envelopes(spark, root), AS_OF, landing.PAYLOADS)
    good = done.select("platform", F.lit("normalized").alias("reason"))
    return good.unionByName(rejected.select("platform", "reason")).groupBy("platform", "reason").agg(
        F.count(F.lit(1)).alias("records"))


K_STANDARD = sq.lookup("array_to_string(list_transform(string_split(trim(category), ' '), "
                       "lambda w: upper(w[1]) || lower(w[2:])), ' ')", vocab.KALSHI_CATEGORY_MAP, "Other")
P_STANDARD = sq.lookup("trim(category)", vocab.POLYMARKET_CATEGORY_MAP, "Other")
ASK_YES = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN yes_ask > 0 THEN yes_ask END, "
           "CASE WHEN last_price > 0 THEN last_price END, 0.5::DOUBLE)))")
ASK_NO = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN no_ask > 0 THEN no_ask END, "
          "1.0::DOUBLE - coalesce(CASE WHEN yes_ask > 0 THEN yes_ask END, 0.5::DOUBLE))))")


@query("b4_kalshi_extractor_rows", f"""
    SELECT coalesce(nullif(ticker, ''), id) AS external_id, title, coalesce(subtitle, nullif(title, '')) AS description,
           {K_STANDARD} AS category, {ASK_YES} AS yes_price, {ASK_NO} AS no_price,
           CASE WHEN n % 8 = 0 OR n % 6 <> 0 AND n % 14 <> 0 THEN created_ts END AS created_date,
           close_ts AS end_date, liquidity / 1000 AS volume, liquidity
    FROM raw_kalshi""", r="yes_price no_price")
def _(spark, root):
    return normalize.kalshi_extracted(kalshi_records(spark, root)).select(
        "external_id", "title", "description", "category", "yes_price", "no_price", "created_date", "end_date",
        "volume", "liquidity")


TRADED = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(lastTradePrice, (bestBid + bestAsk) / 2, "
          "0.5::DOUBLE)))")


@query("b5_polymarket_extractor_rows", f"""
    SELECT id AS external_id, coalesce(question, 'Untitled Market') AS title,
           coalesce(description, question, 'Untitled Market') AS description, {P_STANDARD} AS category,
           coalesce(tag_text, lower({P_STANDARD})) AS tags,
           CASE WHEN len(outcome_names) >= 2 THEN outcome_names[1] ELSE 'Yes' END AS first_outcome,
           CASE WHEN len(outcome_names) >= 2 THEN outcome_names[2] ELSE 'No' END AS second_outcome,
           {TRADED} AS yes_price, 1 - {TRADED} AS no_price, start_ts AS created_date,
           coalesce(end_ts, TIMESTAMP '2002-10-15 00:00:00') AS end_date, coalesce(volume_digits, 0) AS volume
    FROM raw_polymarket""", r="yes_price no_price volume")
def _(spark, root):
    rows = normalize.polymarket_extracted(polymarket_records(spark, root), AS_OF)
    return rows.select("external_id", "title", "description", "category", "tags", "first_outcome", "second_outcome",
                       "yes_price", "no_price", "created_date", "end_date", "volume")


@query("b6_zipped_outcomes", """
    SELECT n, o.i AS position, 't' || n || (CASE o.i WHEN 1 THEN 'a' ELSE 'b' END) AS outcome_id,
           outcome_names[o.i] AS name, (CASE o.i WHEN 1 THEN cents ELSE 100 - cents END) / 100.0::DOUBLE AS price
    FROM raw_polymarket JOIN (SELECT unnest([1, 2]) AS i) o
      ON o.i <= least(coalesce(len(outcome_names), 0), n_prices, n_tokens)""")
def _(spark, root):
    raw = derived.raw_polymarket(spark, root)
    zipped = outcomes.zipped(F.col("outcomes"), F.col("outcomePrices"), F.col("clobTokenIds"))
    return raw.select("n", F.posexplode(zipped).alias("pos", "o")).select(
        "n", (F.col("pos") + 1).alias("position"), F.col("o.id").alias("outcome_id"), F.col("o.name").alias("name"),
        F.col("o.price").alias("price"))


@query("b7_ask_outcomes", """
    SELECT n, ticker || s.tag AS outcome_id, s.name, coalesce(CASE s.name WHEN 'Yes' THEN yes_ask ELSE no_ask END, 0)
           AS price FROM raw_kalshi, (VALUES ('-yes', 'Yes'), ('-no', 'No')) s(tag, name)""")
def _(spark, root):
    raw = derived.raw_kalshi(spark, root)
    sides = outcomes.asks(F.col("ticker"), F.col("yes_ask"), F.col("no_ask"), F.lit(None).cast("double"))
    return raw.select("n", F.explode(sides).alias("o")).select("n", F.col("o.id").alias("outcome_id"),
                                                               F.col("o.name").alias("name"), F.col("o.price").alias("price"))


def quoted_sql(side: str, cents: bool = False, one_sided: bool = True) -> str:
    bid, ask, last = (f"coalesce({c}, 0)" for c in (f"{side}_bid", f"{side}_ask", "last_price"))
    share = (lambda c: f"(CASE WHEN {c} > 1 THEN {c} / 100 ELSE {c} END)") if cents else (lambda c: c)
    traded = share(last) if side == "yes" else f"1 - {share(last)}"
    tail = f"WHEN {ask} > 0 THEN {share(ask)} WHEN {bid} > 0 THEN {share(bid)} " if one_sided else ""
    return (f"CASE WHEN {bid} > 0 AND {ask} > 0 AND {ask} > {bid} THEN ({share(bid)} + {share(ask)}) / 2 "
            f"WHEN {last} > 0 THEN {traded} {tail}ELSE 0.5::DOUBLE END")


TITLED = "coalesce(nullif(title, ''), 'Untitled Market')"


@query("b8_kalshi_populate_rows", f"""
    SELECT ticker AS external_id, {TITLED} AS title, coalesce(subtitle, {TITLED}) AS description,
           {sq.first_match(f'lower({TITLED})', vocab.TITLE_CATEGORY_RULES['populate'], "'other'")} AS category,
           {quoted_sql('yes')} AS yes_price, {quoted_sql('no')} AS no_price, liquidity / 1000 AS volume,
           CASE WHEN liquidity > 0 THEN liquidity ELSE open_interest END AS liquidity, close_time AS end_date
    FROM raw_kalshi""", r="yes_price no_price")
def _(spark, root):
    return normalize.kalshi_populated(kalshi_records(spark, root)).drop("platform", "is_active")


LENIENT = ("CASE WHEN lastTradePrice IS NOT NULL THEN coalesce(nullif(lastTradePrice, 0), 0.5::DOUBLE) "
           "WHEN bestBid IS NOT NULL THEN (coalesce(nullif(bestBid, 0), 0) + coalesce(nullif(bestAsk, 0), 1)) / 2 "
           "ELSE 0.5::DOUBLE END")


@query("b9_polymarket_populate_rows", f"""
    SELECT id AS external_id, question AS title, coalesce(description, question) AS description,
           coalesce(lower(category), 'other') AS category, {LENIENT} AS yes_price, 1 - {LENIENT} AS no_price,
           coalesce(CASE WHEN volumeNum > 0 THEN volumeNum END, volume_digits, 0) AS volume,
           active AND NOT archived AS is_active
    FROM raw_polymarket WHERE id IS NOT NULL AND question IS NOT NULL AND outcome_names IS NOT NULL
      AND (len(list_filter(outcome_names, lambda o: contains(lower(o), 'yes') OR contains(lower(o), 'no'))) > 0
           OR len(outcome_names) <= 4)""", r="yes_price no_price volume")
def _(spark, root):
    return normalize.polymarket_populated(polymarket_records(spark, root)).drop("platform", "liquidity", "end_date")


UNIFIED_CATEGORY = sq.lookup("lower(trim(category))", vocab.UNIFIED_CATEGORY_MAP, "other")


@query("b10_kalshi_unified_rows", f"""
    SELECT 'kalshi-' || external_id AS id, event_id, title, title AS description, {UNIFIED_CATEGORY} AS category,
           coalesce(nullif(yes_price, 0), 0.5) AS yes_price, coalesce(nullif(no_price, 0), 0.5) AS no_price, volume,
           open_interest, is_active AS can_trade, title_normalized, title_hash
    FROM markets WHERE platform = 'kalshi'""")
def _(spark, root):
    m = derived.venue(derived.markets(spark, root), "kalshi")
    rows = m.select(F.col("external_id").alias("ticker"), F.col("event_id").alias("event_ticker"), "title", "category",
                    "volume", "liquidity", "open_interest", "yes_price", "no_price", "status", "is_active", "close_time")
    return normalize.kalshi_unified(rows).select(
        "id", "event_id", "title", "description", "category", "yes_price", "no_price", "volume", "open_interest",
        "can_trade", "title_normalized", "title_hash")


@query("b11_polymarket_unified_rows", f"""
    SELECT 'polymarket-' || external_id AS id, title,
           CASE WHEN length(description || ' details') > length(title) THEN description || ' details'
                ELSE title END AS description, {UNIFIED_CATEGORY} AS category,
           coalesce(nullif(yes_price, 0), 0.5) AS yes_price, true AS is_active, title_hash
    FROM markets WHERE platform = 'polymarket'""")
def _(spark, root):
    m = derived.venue(derived.markets(spark, root), "polymarket")
    raw = m.withColumn("raw_data", F.to_json(F.struct(F.concat("description", F.lit(" details")).alias("description"))))
    rows = normalize.polymarket_unified(raw.withColumn("description", F.col("title")))
    return rows.select("id", "title", "description", "category", "yes_price", "is_active", "title_hash")


@query("b12_kalshi_outcomes", f"""
    SELECT n, s.name, CASE s.name WHEN 'Yes' THEN {K_QUOTE} ELSE 1 - {K_QUOTE} END AS price, 0.0::DOUBLE AS volume
    FROM raw_kalshi, (VALUES ('Yes'), ('No')) s(name)""", r="price")
def _(spark, root):
    raw = derived.raw_kalshi(spark, root)
    quote = prices.normalize_price(F.coalesce("yes_bid", "yes_ask", F.lit(0.5)), numeric=True)
    zero = F.lit("0").cast("decimal(18,2)")
    return raw.select("n", F.explode(outcomes.yes_no(quote, zero, zero)).alias("o")).select(
        "n", "o.name", "o.price", "o.volume")


@query("b13_listed_outcomes", """
    SELECT n, s.name, least(greatest(CASE s.name WHEN 'Yes' THEN cents ELSE 100 - cents END / 100.0::DOUBLE,
           0.0001::DOUBLE), 0.9999::DOUBLE) AS price, round(coalesce(volume_digits, 0) * 100) / 100 AS volume
    FROM raw_polymarket, (VALUES ('Yes'), ('No')) s(name)""", r="price volume")
def _(spark, root):
    raw = derived.raw_polymarket(spark, root)
    shown = F.from_json("outcomePrices", "array<string>")
    yes = F.round(shown[0].cast("double") * 100)
    objects = F.to_json(F.array(*[
        F.struct(F.lit(name).alias("name"), p.cast("decimal(18,2)").cast("string").alias("price"), F.col("volume").alias("volume"))
        for name, p in (("Yes", yes / 100), ("No", (100 - yes) / 100))]))
    return raw.select("n", F.explode(outcomes.listed(objects)).alias("o")).select("n", "o.name", "o.price", "o.volume")


@query("b14_outcome_names", """
    SELECT n, CASE WHEN len(outcome_names) >= 2 THEN outcome_names[1] || ',' || outcome_names[2] ELSE 'Yes,No' END
           AS names FROM raw_polymarket""")
def _(spark, root):
    return derived.raw_polymarket(spark, root).select("n", outcomes.two_names(F.col("outcomes")).alias("names"))


@query("b15_backend_status", """
    SELECT id AS external_id, question AS title,
           CASE WHEN closed THEN 'resolved' WHEN active THEN 'active' ELSE 'closed' END AS status,
           'https://polymarket.com/event/' || slug AS url FROM raw_polymarket
    UNION ALL SELECT ticker, title, CASE WHEN status = 'open' THEN 'active' ELSE 'closed' END,
           'https://kalshi.com/markets/' || ticker FROM raw_kalshi""")
def _(spark, root):
    poly = normalize.backend_polymarket(derived.raw_polymarket(spark, root))
    kal = normalize.backend_kalshi(derived.raw_kalshi(spark, root))
    columns = ["external_id", "title", "status", "url"]
    return poly.select(columns).unionByName(kal.select(columns))


@query("b16_kalshi_status", f"SELECT n, {K_STATUS} AS status FROM raw_kalshi")
def _(spark, root):
    end = dates.parse_date(F.col("close_time"), AS_OF)
    return derived.raw_kalshi(spark, root).select("n", categories.kalshi_status(
        F.col("status"), end, dates.as_timestamp(AS_OF)).alias("status"))


@query("b17_polymarket_status", f"SELECT n, {P_STATUS} AS status FROM raw_polymarket")
def _(spark, root):
    end = dates.parse_date(F.col("endDate"), AS_OF)
    return derived.raw_polymarket(spark, root).select("n", categories.polymarket_status(
        F.col("closed"), F.col("active"), end, dates.as_timestamp(AS_OF)).alias("status"))


@query("b18_event_types", f"SELECT n, {sq.event_type('title', 'category')} AS event_type FROM markets")
def _(spark, root):
    return derived.markets(spark, root).select("n", categories.event_type(F.col("title"), F.col("category")).alias("event_type"))


@query("b19_stream_payload", f"""
    SELECT coalesce(id, ticker, '') AS external_id, title, coalesce(volume, 0) AS volume, {K_QUOTE} AS first_price,
           strftime({IN_RANGE('close_ts')}, '%Y-%m-%dT%H:%M:%S') AS end_date FROM raw_kalshi""", r="volume first_price")
def _(spark, root):
    df = normalize.kalshi(kalshi_records(spark, root), AS_OF)
    part = lambda p: F.get_json_object("payload", f"$.{p}")
    return df.select(normalize.stream_payload(df).alias("payload")).select(
        part("external_id").alias("external_id"), part("title").alias("title"), part("volume").cast("double").alias("volume"),
        part("outcomes[0].price").cast("double").alias("first_price"), part("end_date").alias("end_date"))


@query("b20_title_normalization", "SELECT n, title_normalized, title_hash FROM markets")
def _(spark, root):
    return derived.markets(spark, root).select("n", text.normalized_title(F.col("title")).alias("title_normalized"),
                                               text.title_prefix_hash(F.col("title")).alias("title_hash"))


@query("b21_keyword_title_hash", f"""
    SELECT doc_id, substring(regexp_replace(regexp_replace(lower(text),
           '\\b({'|'.join(vocab.HASH_STOP_WORDS)})\\b', '', 'g'), '\\s+', '_', 'g'), 1, 30) AS title_hash
    FROM documents""")
def _(spark, root):
    docs = derived.table(spark, root, "documents")
    return docs.select("doc_id", text.keyword_title_hash(F.col("text")).alias("title_hash"))


@query("b22_description_repair", """
    SELECT id, CASE WHEN n % 7 = 0 THEN title ELSE description END AS description FROM markets""")
def _(spark, root):
    m = derived.markets(spark, root)
    unified = m.select("id", F.col("title").alias("description"))
    raw = m.select("id", F.when(F.col("n") % 7 == 0, None).otherwise(F.col("description")).alias("description"))
    return tables.repair_descriptions(unified, raw)


# --- scalar functions ------------------------------------------------------------------------

ASCII = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\x00-\x7F]', '', 'g')"


@query("i1_clean_text", f"""
    SELECT doc_id, CASE WHEN length(a) > 200 THEN
             (CASE WHEN contains(left(a, 200), ' ') THEN regexp_replace(left(a, 200), ' [^ ]*$', '')
                   ELSE left(a, 200) END) || '...' ELSE a END AS cleaned
    FROM (SELECT doc_id, {ASCII} AS a FROM documents)""")
def _(spark, root):
    return derived.table(spark, root, "documents").select("doc_id", text.clean_text(F.col("text"), 200).alias("cleaned"))


@query("i2_substring_tests", f"""
    SELECT doc_id, {has_any('lower(text)', ('the', 'est'))} AS has_any,
           contains(lower(text), 'the') AND contains(lower(text), 'est') AS has_all,
           {hits('lower(text)', ('the', 'est', 'license', 'copyright'))} AS n_hits FROM documents""")
def _(spark, root):
    low = F.lower("text")
    return derived.table(spark, root, "documents").select(
        "doc_id", text.contains_any(low, ("the", "est")).alias("has_any"),
        text.contains_all(low, ("the", "est")).alias("has_all"),
        text.count_hits(low, ("the", "est", "license", "copyright")).alias("n_hits"))


@query("i12_short_descriptions", """
    SELECT n, CASE WHEN length(description) > 10 THEN substring(description, 1, 12) || '...' ELSE title END AS short
    FROM markets""")
def _(spark, root):
    return derived.markets(spark, root).select("n", text.short_description(
        F.col("description"), F.col("title"), 12).alias("short"))


@query("i13_price_text", """
    SELECT n, least(greatest(cents / 100.0::DOUBLE, 0.0001::DOUBLE), 0.9999::DOUBLE) AS from_text,
           CASE WHEN lastTradePrice IS NULL THEN 0.5::DOUBLE
                ELSE least(greatest(lastTradePrice, 0.0001::DOUBLE), 0.9999::DOUBLE) END AS from_number
    FROM raw_polymarket""", r="from_text from_number")
def _(spark, root):
    raw = derived.raw_polymarket(spark, root)
    shown = F.concat(F.lit("$"), F.from_json("outcomePrices", "array<string>")[0])
    return raw.select("n", prices.normalize_price(shown).alias("from_text"),
                      prices.normalize_price(F.col("lastTradePrice"), numeric=True).alias("from_number"))


@query("i14_volume_text", """
    SELECT n, round(coalesce(volume_digits, 0) * 100) / 100 AS volume FROM raw_polymarket""", r="volume")
def _(spark, root):
    return derived.raw_polymarket(spark, root).select("n", prices.normalize_volume(F.col("volume")).alias("volume"))


@query("i15_quoted_prices", f"""
    SELECT n, {quoted_sql('yes')} AS populate_yes, {quoted_sql('no')} AS populate_no,
           {quoted_sql('yes', True, False)} AS share_yes, {quoted_sql('no', True, False)} AS share_no
    FROM raw_kalshi""", r="populate_yes populate_no share_yes share_no")
def _(spark, root):
    side = lambda s, **kw: prices.quoted_price(F.col(f"{s}_bid"), F.col(f"{s}_ask"), F.col("last_price"), s, **kw)
    return derived.raw_kalshi(spark, root).select(
        "n", side("yes", one_sided=True).alias("populate_yes"), side("no", one_sided=True).alias("populate_no"),
        side("yes", cents=True).alias("share_yes"), side("no", cents=True).alias("share_no"))


@query("i16_asked_prices", f"SELECT n, {ASK_YES} AS yes_price, {ASK_NO} AS no_price FROM raw_kalshi", r="yes_price no_price")
def _(spark, root):
    none = F.lit(None).cast("double")
    return derived.raw_kalshi(spark, root).select(
        "n", prices.asked_price(F.col("yes_ask"), none, F.col("last_price")).alias("yes_price"),
        prices.asked_no_price(F.col("no_ask"), none, F.col("yes_ask"), none).alias("no_price"))


@query("i17_traded_prices", f"SELECT n, {TRADED} AS strict, {LENIENT} AS lenient FROM raw_polymarket", r="strict lenient")
def _(spark, root):
    quote = [F.col(c) for c in ("lastTradePrice", "bestBid", "bestAsk")]
    return derived.raw_polymarket(spark, root).select("n", prices.traded_price(*quote).alias("strict"),
                                                      prices.lenient_traded_price(*quote).alias("lenient"))


@query("i18_volume_proxies", """
    SELECT n, coalesce(CASE WHEN volume > 0 THEN volume END, CASE WHEN open_interest > 0 THEN open_interest END,
             CASE WHEN liquidity > 0 THEN liquidity / 1000 END, 0) AS chain,
           CASE WHEN volume = 0 AND liquidity > 0 THEN liquidity / 1000 ELSE volume END AS if_zero,
           liquidity / 1000 AS always FROM raw_kalshi""")
def _(spark, root):
    parts = [F.col(c) for c in ("volume", "open_interest", "liquidity")]
    return derived.raw_kalshi(spark, root).select(
        "n", *[prices.volume_proxy(*parts, s).alias(s) for s in ("chain", "if_zero", "always")])


@query("i19_yes_prices", """
    SELECT n, CASE WHEN len(outcome_names) >= 1 AND n_prices = 2 AND n_tokens = 2 THEN cents / 100.0::DOUBLE
                   WHEN n_prices = 1 AND n_tokens = 2 AND len(outcome_names) >= 1 THEN cents / 100.0::DOUBLE
                   ELSE 0.5::DOUBLE END AS yes_price FROM raw_polymarket""", r="yes_price")
def _(spark, root):
    zipped = outcomes.zipped(F.col("outcomes"), F.col("outcomePrices"), F.col("clobTokenIds"))
    return derived.raw_polymarket(spark, root).select("n", outcomes.yes_price(zipped).alias("yes_price"))


@query("i20_price_validity", "SELECT n, yes_price BETWEEN 0.01 AND 0.99 AS is_valid FROM markets")
def _(spark, root):
    return derived.markets(spark, root).select("n", F.col("yes_price").between(0.01, 0.99).alias("is_valid"))


@query("i22_liquidity_scores", f"""
    SELECT n, {sq.liquidity_score('volume', 'yes_price')} AS score FROM markets""", r="score")
def _(spark, root):
    return derived.markets(spark, root).select("n", prices.liquidity_score(F.col("volume"), F.col("yes_price")).alias("score"))


@query("i26_parsed_dates", """
    SELECT n, created_ts AS created FROM raw_kalshi""")
def _(spark, root):
    wide = normalize.NormalizationConfig(past_days=36500, future_days=36500)
    return derived.raw_kalshi(spark, root).select("n", dates.parse_date(F.col("created_time"), AS_OF, wide).alias("created"))


@query("i27_iso_dates", "SELECT n, end_ts AS strict, coalesce(end_ts, TIMESTAMP '2002-10-15') AS defaulted FROM raw_polymarket")
def _(spark, root):
    default = F.lit("2002-10-15 00:00:00").cast("timestamp")
    return derived.raw_polymarket(spark, root).select("n", dates.parse_iso(F.col("endDate")).alias("strict"),
                                                      dates.parse_iso(F.col("endDate"), default).alias("defaulted"))


@query("i29_calendar_days", "SELECT n, strftime(open_time, '%Y-%m-%d') AS open_day FROM markets")
def _(spark, root):
    return derived.markets(spark, root).select("n", F.to_date("open_time").cast("string").alias("open_day"))


@query("i30_json_paths", """
    SELECT coalesce(nullif(ticker, ''), id) AS external_id, CAST(round(volume) AS BIGINT) AS volume_whole,
           liquidity AS liquidity_number, status FROM raw_kalshi WHERE coalesce(nullif(ticker, ''), id) IS NOT NULL""")
def _(spark, root):
    return kalshi_envelopes(spark, root).select(
        "external_id", browse.payload_whole("volume").alias("volume_whole"),
        browse.payload_number("liquidity").alias("liquidity_number"), F.get_json_object("raw_data", "$.status").alias("status"))


@query("i31_json_arrays", """
    SELECT n, coalesce(len(outcome_names), -1) AS size, CASE WHEN outcome_names IS NOT NULL THEN outcomes END AS again
    FROM raw_polymarket""")
def _(spark, root):
    parsed = outcomes.names(F.col("outcomes"))
    return derived.raw_polymarket(spark, root).select("n", F.coalesce(F.size(parsed), F.lit(-1)).alias("size"),
                                                      F.to_json(parsed).alias("again"))


@query("i32_pair_hashes", """
    SELECT kalshi_id, polymarket_id, md5(kalshi_id || '_' || polymarket_id || '_' || reasoning) AS pair_hash FROM evals""")
def _(spark, root):
    return derived.evaluations(spark, root).select("kalshi_id", "polymarket_id", text.pair_hash(
        F.col("kalshi_id"), F.col("polymarket_id"), F.col("reasoning")).alias("pair_hash"))


@query("i33_standard_categories", f"""
    SELECT n, {K_STANDARD} AS kalshi_style, {P_STANDARD} AS polymarket_style, {UNIFIED_CATEGORY} AS unified_style,
           {sq.lookup('category', vocab.DOCUMENTED_CATEGORY_MAP, 'other')} AS documented_style
    FROM (SELECT n, category FROM raw_kalshi UNION ALL SELECT n, category FROM raw_polymarket)""")
def _(spark, root):
    both = derived.raw_kalshi(spark, root).select("n", "category").unionByName(
        derived.raw_polymarket(spark, root).select("n", "category"))
    return both.select("n", *[categories.standardize(F.col("category"), s).alias(f"{s}_style")
                              for s in ("kalshi", "polymarket", "unified", "documented")])


@query("i34_normalized_categories", f"""
    SELECT n, {sq.normalized_category('category', 'title', 'kalshi')} AS category FROM raw_kalshi
    UNION ALL SELECT n, {sq.normalized_category('category', 'title', 'polymarket')} FROM raw_polymarket""")
def _(spark, root):
    k = derived.raw_kalshi(spark, root).select("n", categories.normalized(F.col("category"), F.col("title"), "kalshi").alias("category"))
    p = derived.raw_polymarket(spark, root).select("n", categories.normalized(F.col("category"), F.col("title"), "polymarket").alias("category"))
    return k.unionByName(p)


@query("i35_title_categories", "SELECT n, " + ", ".join(
    f"""{sq.first_match('lower(title)', rules, "'other'" if name in ('populate', 'capture') else "'Other'")} AS {name}_rules"""
    for name, rules in vocab.TITLE_CATEGORY_RULES.items()) + " FROM markets")
def _(spark, root):
    return derived.markets(spark, root).select("n", *[categories.from_title(F.col("title"), s).alias(f"{s}_rules")
                                                     for s in vocab.TITLE_CATEGORY_RULES])


GOOD, BAD = hits("t", vocab.POSITIVE_WORDS), hits("t", vocab.NEGATIVE_WORDS)


@query("i36_sentiment", f"""
    SELECT doc_id, CASE WHEN g + b = 0 THEN 0.0::DOUBLE ELSE (g - b)::DOUBLE / (g + b) END AS score,
           CASE WHEN g + b = 0 THEN 'neutral' WHEN (g - b)::DOUBLE / (g + b) > 0.2 THEN 'positive'
                WHEN (g - b)::DOUBLE / (g + b) < -0.2 THEN 'negative' ELSE 'neutral' END AS label,
           CASE WHEN g + b = 0 THEN 0.3::DOUBLE ELSE least(0.9::DOUBLE, (g + b) / 10.0::DOUBLE) END AS confidence,
           array_to_string(list_filter([{quoted(vocab.POSITIVE_WORDS + vocab.NEGATIVE_WORDS)}],
                           lambda w: contains(t, w))[1:5], ',') AS phrases
    FROM (SELECT *, {GOOD} AS g, {BAD} AS b FROM (SELECT doc_id, lower(text || ' ' || source) AS t FROM documents))""",
       r="score confidence")
def _(spark, root):
    docs = derived.table(spark, root, "documents")
    return docs.select("doc_id", text.sentiment(F.col("text"), F.col("source")).alias("s")).select("doc_id", "s.*")


@query("i38_reply_lines", """
    SELECT kalshi_id, polymarket_id, confidence_score AS confidence, reasoning FROM evals""")
def _(spark, root):
    line = F.format_string('PAIR 1: confidence=%s, reasoning="%s"', F.col("confidence_score").cast("string"), F.col("reasoning"))
    return derived.evaluations(spark, root).select("kalshi_id", "polymarket_id", replies.line_confidence(line).alias("confidence"),
                                                   replies.line_reasoning(line).alias("reasoning"))


@query("i40_composite_keys", "SELECT platform || '-' || external_id AS id, platform || ':' || external_id AS message_key FROM markets")
def _(spark, root):
    return derived.markets(spark, root).select(F.concat_ws("-", "platform", "external_id").alias("id"),
                                               F.concat_ws(":", "platform", "external_id").alias("message_key"))
