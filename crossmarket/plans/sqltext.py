"""SQL text built from the fixed rule tables, for the checking statements."""

from __future__ import annotations

from crossmarket.functions import vocab
from crossmarket.plans.oracle_views import T, has_any, hits, quoted  # noqa: F401

ARRAY = lambda words: f"[{quoted(words)}]"


def first_match(text: str, rules, default: str) -> str:
    arms = " ".join(f"WHEN {has_any(text, words)} THEN '{name}'" for name, words in rules)
    return f"CASE {arms} ELSE {default} END"


def normalized_category(category: str, title: str, venue: str) -> str:
    given = f"coalesce(nullif({category}, ''), 'Other')"
    rules = vocab.VENUE_CATEGORY_RULES[venue]
    arms = [f"WHEN lower({given}) = '{listed.lower()}' THEN '{name}'" for listed, name, c, _ in rules if c >= 0.7]
    arms += [f"WHEN {hits(f'lower({title})', words)} / {len(words)}.0::DOUBLE >= 0.7 THEN '{name}'"
             for _, name, _, words in rules if words]
    return f"CASE {' '.join(arms)} ELSE {given} END"


def event_type(title: str, category: str) -> str:
    arms = [f"WHEN {has_any(f'lower({title})', words)} THEN '{name}'" for name, words in vocab.EVENT_TYPE_TITLE_RULES]
    arms += [f"WHEN contains(lower({category}), '{w}') THEN '{name}'" for name, w in vocab.EVENT_TYPE_CATEGORY_RULES]
    return f"CASE {' '.join(arms)} ELSE 'other' END"


def lookup(value: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {value} {arms} ELSE '{default}' END"


def keyword_bucket(title: str = "title", category: str = "category") -> str:
    arms = []
    for name, alternatives in vocab.KEYWORD_BUCKETS:
        cond = " OR ".join("(" + " AND ".join(f"lower({title}) LIKE '%{w}%'" for w in words) + ")"
                           for words in alternatives)
        arms.append(f"WHEN {cond} THEN '{name}'")
    arms += [f"WHEN {category} = '{c}' THEN '{b}'" for c, b in vocab.CATEGORY_BUCKETS.items()]
    return f"CASE {' '.join(arms)} ELSE 'miscellaneous' END"


def bucket_steps(cfg, source: str = "markets") -> dict[str, str]:
    """The bucket fold as one CTE per definition, in order."""
    views = {"fold0": f"""
        SELECT *, 'miscellaneous' AS bucket, 0.0::DOUBLE AS points,
               lower(title) || ' ' || lower(coalesce(description, '')) AS body FROM {source}"""}
    for i, b in enumerate(vocab.BUCKETS, start=1):
        exact = f"category IN ({quoted(b.categories)})"
        partial = has_any("lower(category)", [c.lower() for c in b.categories])
        score = (f"least({cfg.keyword_cap}::DOUBLE, {hits('body', b.keywords)} / {len(b.keywords)}.0::DOUBLE * "
                 f"{cfg.keyword_scale}::DOUBLE) + CASE WHEN {exact} THEN {cfg.category_exact}::DOUBLE "
                 f"WHEN {partial} THEN {cfg.category_partial}::DOUBLE ELSE 0.0::DOUBLE END")
        if b.window_start:
            score += (f" + CASE WHEN close_time >= TIMESTAMP '{b.window_start}' THEN {cfg.window_end}::DOUBLE "
                      f"WHEN open_time >= TIMESTAMP '{b.window_start}' THEN {cfg.window_start}::DOUBLE "
                      "ELSE 0.0::DOUBLE END")
        score = f"least(100.0::DOUBLE, {score})"
        if b.required:
            needed = " AND ".join(f"contains(body, '{w}')" for w in b.required)
            score = f"CASE WHEN {needed} THEN {score} ELSE 0.0::DOUBLE END"
        boost = float((5 - b.priority) * 5) if cfg.use_boost else 0.0
        compare = ">" if cfg.strict_minimum else ">="
        wins = f"s + {boost} > points AND s {compare} {cfg.min_score}"
        views[f"fold{i}"] = f"""
        SELECT * EXCLUDE (s) REPLACE (CASE WHEN {wins} THEN '{b.name}' ELSE bucket END AS bucket,
               CASE WHEN {wins} THEN s ELSE points END AS points)
        FROM (SELECT *, {score} AS s FROM fold{i - 1})"""
    views["bucketed"] = f"SELECT *, points / 100.0::DOUBLE AS bucket_confidence FROM fold{len(vocab.BUCKETS)}"
    return views


def tokens(text: str, stop=()) -> str:
    words = f"list_distinct(regexp_split_to_array(trim(lower({text})), '\\s+'))"
    return f"list_filter({words}, lambda w: w <> '' AND NOT list_contains({ARRAY(list(stop) or ['~'])}, w))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"{shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END")


def liquidity_score(volume: str, price: str) -> str:
    adj = f"({volume} * greatest(0.1::DOUBLE, 1.0::DOUBLE - abs({price} - 0.5::DOUBLE) * 2))"
    return f"CASE WHEN {adj} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, log10({adj} + 1) / 4) END"


def shared_keyword(a: str, b: str, words) -> str:
    return "(" + " OR ".join(f"(contains(lower({a}), '{w}') AND contains(lower({b}), '{w}'))" for w in words) + ")"


def keyword_points(a: str, b: str, table) -> str:
    arms = " ".join(f"WHEN contains(lower({a}), '{w}') AND contains(lower({b}), '{w}') THEN {pts}" for w, pts in table)
    return f"CASE {arms} ELSE 0 END"


PAIR_SIDES = """
    k.id AS kalshi_id, p.id AS polymarket_id, k.title AS kalshi_title, p.title AS polymarket_title,
    k.category AS kalshi_category, p.category AS polymarket_category, k.yes_price AS kalshi_price,
    p.yes_price AS polymarket_price, k.volume AS kalshi_volume, p.volume AS polymarket_volume,
    k.close_time AS kalshi_close_time, p.close_time AS polymarket_close_time"""
