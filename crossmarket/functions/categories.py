"""Category, event-type and status rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossmarket.functions import vocab
from crossmarket.functions.text import contains_any, count_hits, first_match, title_case


def lookup(value: Column, mapping: dict[str, str], default: str) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(entries, value), F.lit(default))


def standardize(category: Column, style: str, title: Column | None = None,
                fallback_on_other: bool = False) -> Column:
    """Venue category to a standard name.

    style: "kalshi", "polymarket", "unified" or "documented". With fallback_on_other the title
    rules decide where the map only says Other.
    """
    if style == "kalshi":
        name = lookup(title_case(category), vocab.KALSHI_CATEGORY_MAP, "Other")
    elif style == "polymarket":
        name = lookup(F.trim(category), vocab.POLYMARKET_CATEGORY_MAP, "Other")
    elif style == "unified":
        name = lookup(F.lower(F.trim(category)), vocab.UNIFIED_CATEGORY_MAP, "other")
    elif style == "documented":
        name = lookup(category, vocab.DOCUMENTED_CATEGORY_MAP, "other")
    else:
        raise ValueError(f"unknown category style: {style}")
    if fallback_on_other and title is not None:
        return F.when(name == "Other", from_title(title, style)).otherwise(name)
    return name


def from_title(title: Column, rules: str) -> Column:
    default = "other" if rules in ("populate", "capture") else "Other"
    return first_match(F.lower(F.coalesce(title, F.lit(""))), vocab.TITLE_CATEGORY_RULES[rules], default)


def normalized(category: Column, title: Column, venue: str, threshold: float = 0.7) -> Column:
    """Listed category where trusted, else the first rule enough of whose title words occur."""
    given = F.coalesce(F.nullif(category, F.lit("")), F.lit("Other"))
    text = F.lower(title)
    chain = None
    rules = vocab.VENUE_CATEGORY_RULES[venue]
    for listed, name, confidence, _ in rules:
        if confidence >= threshold:
            hit = F.lower(given) == listed.lower()
            chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    for _, name, _, words in rules:
        if words:
            chain = chain.when(count_hits(text, words) / len(words) >= threshold, F.lit(name))
    return chain.otherwise(given)


def event_type(title: Column, category: Column) -> Column:
    text, cat = F.lower(title), F.lower(category)
    by_category = F.lit("other")
    for label, word in reversed(vocab.EVENT_TYPE_CATEGORY_RULES):
        by_category = F.when(cat.contains(word), F.lit(label)).otherwise(by_category)
    return first_match(text, vocab.EVENT_TYPE_TITLE_RULES, by_category)


def kalshi_status(status: Column, close: Column, as_of: Column) -> Column:
    word = F.lower(F.coalesce(status, F.lit("")))
    return (F.when(word.isin("open", "active"), "active")
            .when(word.isin("closed", "settled"), "closed")
            .when(word.isin("suspended", "halted"), "suspended")
            .when(close < as_of, "closed").otherwise("active"))


def polymarket_status(closed: Column, active: Column, end: Column, as_of: Column) -> Column:
    return (F.when(F.coalesce(closed, F.lit(False)), "closed")
            .when(F.coalesce(active, F.lit(True)), "active")
            .when(end < as_of, "closed").otherwise("active"))


def backend_status(closed: Column, active: Column) -> Column:
    return (F.when(F.coalesce(closed, F.lit(False)), "resolved")
            .when(F.coalesce(active, F.lit(False)), "active").otherwise("closed"))


def repaired_first(category: Column, title: Column, description: Column, wide: bool = False) -> Column:
    """Category of listings marked other, by the first rule found in title or description."""
    text_t, text_d = F.lower(title), F.lower(F.coalesce(description, F.lit("")))
    chain = None
    for name, pattern in vocab.REPAIR_CATEGORY_REGEXES:
        if wide:
            words = tuple(pattern.split("|")) + vocab.REPAIR_CATEGORY_EXTRA_WORDS.get(name, ())
            hit = contains_any(text_t, words) | contains_any(text_d, words)
        else:
            hit = text_t.rlike(pattern) | text_d.rlike(pattern)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return F.when(category == "other", chain.otherwise(category)).otherwise(category)


def repaired_last(category: Column, title: Column) -> Column:
    """Sequential overrides by title word: the last matching word decides."""
    text = F.lower(title)
    chain = None
    for word, name in reversed(vocab.OVERRIDE_CATEGORY_WORDS):
        hit = text.contains(word)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(category)
