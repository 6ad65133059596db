"""The derived views stated in ANSI SQL, for checking query results in another engine."""

from __future__ import annotations

import re

from crossmarket.sources.derived import AS_OF, CATEGORY_BY_TYPE, EVALUATION_OFFSETS, TOPICS

T = f"TIMESTAMP '{AS_OF}'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case_map(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {column} = '{a}' THEN '{b}'" for a, b in mapping.items())
    return f"CASE {arms} ELSE {default} END"


def has_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def hits(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) + ")"


def every(k: int) -> str:
    return f"n % {k} = 0"


ISO = "'%Y-%m-%dT%H:%M:%SZ'"

VIEWS: dict[str, str] = {
    "sold": """
        SELECT l_partkey, SUM(l_quantity) AS q,
               SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS x,
               MIN(l_shipdate) AS o, MAX(l_shipdate) AS e
        FROM lineitem GROUP BY l_partkey""",
    "listed": f"""
        SELECT p_partkey AS n, CASE WHEN p_partkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform,
               p_brand AS event_id,
               'Will ' || ([{quoted(TOPICS)}])[CAST((p_partkey // 2) % 24 + 1 AS INT)] || ' ' || p_name
                 || ' resolve yes' AS title,
               p_brand || ' ' || lower(p_type) AS description,
               {case_map('p_type', CATEGORY_BY_TYPE)} AS category,
               ((p_partkey * 37) % 101) AS cents,
               CASE WHEN p_partkey % 53 = 0 THEN 0.0::DOUBLE
                    WHEN p_partkey % 17 = 0 THEN q * (1 + p_partkey % 13) * 0.05::DOUBLE
                    ELSE q * (1 + p_partkey % 13) END AS volume,
               CAST(x AS BIGINT) / 10000.0::DOUBLE AS liquidity, p_partkey % 50 AS open_interest, o AS open_time,
               e + to_days(CAST(p_partkey % 40 AS INT)) AS close_time
        FROM part JOIN sold ON p_partkey = l_partkey""",
    "markets": f"""
        SELECT n, platform, CAST(n AS VARCHAR) AS external_id, platform || '-' || n AS id, event_id,
               title, description, category, cents / 100.0::DOUBLE AS yes_price,
               (100 - cents) / 100.0::DOUBLE AS no_price, volume, liquidity, open_interest, open_time,
               close_time, close_time > {T} AS is_active,
               CASE WHEN close_time > {T} THEN 'active' ELSE 'closed' END AS status,
               trim(regexp_replace(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', ' ', 'g'),
                                   '\\s+', ' ', 'g')) AS title_normalized,
               substring(trim(regexp_replace(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', ' ', 'g'),
                                   '\\s+', ' ', 'g')), 1, 20) AS title_hash
        FROM listed""",
    "unified": """
        SELECT * REPLACE (CASE WHEN n % 5 = 0 THEN 'other' ELSE lower(category) END AS category)
        FROM markets""",
    "evals": f"""
        SELECT k, p, 'kalshi-' || k AS kalshi_id, 'polymarket-' || p AS polymarket_id,
               ((k * 31 + p * 17) % 101) / 100.0::DOUBLE AS confidence_score,
               'score ' || ((k * 31 + p * 17) % 101) AS reasoning,
               ((k * 31 + p * 17) % 101) / 100.0::DOUBLE >= 0.7 AS is_equivalent,
               CASE WHEN (k + p) % 3 = 0 THEN 'screening' ELSE 'deep_analysis' END AS stage,
               {T} - to_hours(CAST((k + p) % 72 AS INT)) AS evaluated_at
        FROM (SELECT a.p_partkey AS k, b.p_partkey AS p FROM part a
              JOIN (SELECT unnest([{', '.join(map(str, EVALUATION_OFFSETS))}]) AS o) ON true
              JOIN part b ON b.p_partkey = a.p_partkey + o WHERE a.p_partkey % 2 = 0)""",
    "history": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS market_id, event_type AS outcome,
               (CAST(floor(value * 100) AS BIGINT) % 98 + 1) / 100.0::DOUBLE AS price, value AS volume,
               ts AS "timestamp"
        FROM events""",
    "run_logs": """
        SELECT o_orderkey AS run_id, o_orderpriority AS stage,
               CASE WHEN o_custkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform,
               o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS processing_time_ms,
               CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS input_count,
               CAST(floor(o_totalprice) AS BIGINT) % 1000 AS output_count,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'error' END AS status,
               o_orderkey % 3 AS error_count,
               CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE 200 END AS api_status
        FROM orders""",
    "raw_kalshi": f"""
        SELECT n, CASE WHEN {every(38)} THEN '' ELSE 'K' || n END AS ticker,
               CASE WHEN {every(94)} OR {every(76)} THEN NULL ELSE 'k-' || n END AS id,
               event_id AS event_ticker, CASE WHEN {every(122)} THEN '' ELSE title END AS title,
               CASE WHEN {every(10)} THEN NULL ELSE description END AS subtitle,
               CASE WHEN {every(26)} THEN NULL WHEN {every(22)} THEN 'Elections'
                    WHEN {every(14)} THEN lower(category) ELSE category END AS category,
               CASE WHEN {every(58)} THEN 'halted' WHEN {every(34)} THEN 'settled' WHEN n % 10 = 0 THEN 'closed'
                    WHEN n % 10 = 2 THEN 'initialized' WHEN n % 10 = 6 THEN 'open' ELSE 'active' END AS status,
               strftime(open_time, {ISO}) AS open_time, open_time AS open_ts,
               CASE WHEN {every(62)} THEN NULL ELSE strftime(close_time, {ISO}) END AS close_time,
               CASE WHEN {every(62)} THEN NULL ELSE close_time END AS close_ts,
               CASE WHEN {every(8)} THEN open_time WHEN {every(6)} THEN date_trunc('day', open_time)
                    WHEN {every(14)} THEN NULL ELSE open_time END AS created_ts,
               CASE WHEN {every(18)} THEN 0.0::DOUBLE ELSE greatest(cents - 1, 0) / unit END AS yes_bid,
               CASE WHEN {every(18)} THEN NULL ELSE (cents + 1) / unit END AS yes_ask,
               greatest(100 - (cents + 1), 0) / unit AS no_bid, (100 - greatest(cents - 1, 0)) / unit AS no_ask,
               CASE WHEN {every(30)} THEN NULL ELSE cents / unit END AS last_price,
               CASE WHEN {every(6)} THEN NULL ELSE volume END AS volume, volume / 10 AS volume_24h,
               CASE WHEN {every(44)} THEN 0.0::DOUBLE ELSE liquidity END AS liquidity, open_interest,
               n % 3 <> 0 AS can_close_early
        FROM (SELECT *, CASE WHEN n % 4 = 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS unit
              FROM listed WHERE platform = 'kalshi')""",
    "raw_polymarket": f"""
        SELECT n, CASE WHEN {every(45)} THEN NULL ELSE 'P' || n END AS id, 'c' || n AS conditionId,
               CASE WHEN {every(121)} THEN NULL ELSE title END AS question, title,
               CASE WHEN {every(7)} THEN NULL ELSE description END AS description,
               CASE WHEN {every(33)} THEN NULL WHEN {every(27)} THEN 'other' WHEN {every(21)} THEN 'Gaming'
                    WHEN {every(15)} THEN 'Pop Culture' ELSE category END AS category, 'm-' || n AS slug,
               CASE WHEN {every(49)} THEN NULL WHEN {every(35)} THEN 'not json'
                    WHEN {every(55)} THEN '["A","B","C","D","E"]' WHEN {every(39)} THEN '["Only"]'
                    WHEN {every(25)} THEN '["Up","Down"]' WHEN {every(9)} THEN '["YES","No","Maybe"]'
                    ELSE '["Yes","No"]' END AS outcomes,
               CASE WHEN {every(49)} OR {every(35)} THEN NULL WHEN {every(55)} THEN ['A','B','C','D','E']
                    WHEN {every(39)} THEN ['Only'] WHEN {every(25)} THEN ['Up','Down']
                    WHEN {every(9)} THEN ['YES','No','Maybe'] ELSE ['Yes','No'] END AS outcome_names,
               cents, CASE WHEN {every(51)} THEN 1 ELSE 2 END AS n_prices,
               CASE WHEN {every(57)} THEN 0 ELSE 2 END AS n_tokens,
               CASE WHEN {every(5)} THEN NULL ELSE cents / 100.0::DOUBLE END AS lastTradePrice,
               CASE WHEN {every(65)} THEN NULL ELSE greatest(cents - 2, 0) / 100.0::DOUBLE END AS bestBid,
               CASE WHEN {every(65)} THEN NULL ELSE (cents + 2) / 100.0::DOUBLE END AS bestAsk,
               CASE WHEN {every(77)} THEN NULL ELSE volume END AS volume_digits, {every(7)} AS dollar,
               CASE WHEN {every(11)} THEN NULL ELSE volume END AS volumeNum, liquidity AS liquidityNum,
               open_time AS start_ts, CASE WHEN {every(63)} OR {every(69)} THEN NULL ELSE close_time END AS end_ts,
               n % 3 <> 0 AS active, {every(13)} AS closed, {every(19)} AS archived,
               CASE WHEN {every(17)} THEN NULL WHEN n % 4 = 1 THEN 'alpha,beta' ELSE 'plain' END AS tag_text
        FROM listed WHERE platform = 'polymarket'""",
    "messages": """
        SELECT *, CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN event_type = 'view' THEN 'market_update'
                   WHEN event_type = 'purchase' THEN 'arbitrage_opportunity'
                   WHEN event_type = 'click' THEN 'pipeline_metrics' WHEN event_type = 'error' THEN 'alert'
                   ELSE 'user_joined' END AS kind,
               (CAST(floor(value * 100) AS BIGINT) % 98 + 1) / 100.0::DOUBLE AS price
        FROM events""",
}


def needed(sql: str, known: dict[str, str]) -> list[str]:
    """Views a statement uses, dependencies first."""
    order: list[str] = []

    def visit(fragment: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", fragment):
                if known[name] is not fragment:
                    visit(known[name])
                    if name not in order:
                        order.append(name)

    visit(sql)
    return order


def oracle(body: str, **extra: str) -> str:
    """A self-contained statement: the views it needs as CTEs, then the body."""
    known = {**VIEWS, **extra}
    # Materialized, so that long chains of views are not expanded into one expression.
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in needed(body, known))
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
