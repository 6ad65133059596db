"""Outcome arrays: reading the venues' encodings and pricing the Yes side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossmarket.functions import prices
from crossmarket.functions.text import string_array

YES_NAMES = ("yes", "true", "1")
OUTCOME = "array<struct<name:string,price:decimal(18,4),volume:decimal(18,2),probability:double>>"


def names(outcomes_json: Column) -> Column:
    """Outcome names from a JSON array of strings; NULL when it is not one."""
    return F.from_json(outcomes_json, "array<string>")


def has_yes_name(outcome_names: Column) -> Column:
    known = string_array(YES_NAMES)
    return F.exists(outcome_names, lambda n: F.array_contains(known, F.lower(n)))


def is_binary(outcomes_json: Column) -> Column:
    """At least two outcomes, one of them a Yes name or exactly two in all."""
    parsed = names(outcomes_json)
    return F.coalesce((F.size(parsed) >= 2) & (has_yes_name(parsed) | (F.size(parsed) == 2)),
                      F.lit(False))


def is_yes_no_or_small(outcomes_json: Column, largest: int = 4) -> Column:
    """A name mentioning yes/no, or few enough outcomes."""
    parsed = F.coalesce(names(outcomes_json), F.array().cast("array<string>"))
    mentions = F.exists(parsed, lambda n: F.contains(F.lower(n), F.lit("yes"))
                        | F.contains(F.lower(n), F.lit("no")))
    return mentions | (F.size(parsed) <= largest)


def two_names(outcomes_json: Column) -> Column:
    parsed = names(outcomes_json)
    return F.when(F.size(parsed) >= 2, F.slice(parsed, 1, 2)).otherwise(string_array(("Yes", "No")))


def zipped(outcomes_json: Column, prices_json: Column, ids_json: Column) -> Column:
    """Three parallel JSON arrays as structs, cut to the shortest, incomplete entries dropped."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(F.from_json(c, "array<string>"), empty)
             for c in (ids_json, outcomes_json, prices_json)]
    usable = F.least(*[F.size(p) for p in parts])
    rows = F.slice(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("id", "name", "price"))]),
                   F.lit(1), usable)
    typed = F.transform(rows, lambda o: F.struct(
        o["id"].alias("id"), o["name"].alias("name"), o["price"].try_cast("double").alias("price"),
        o["price"].isNotNull().alias("priced")))
    kept = F.filter(typed, lambda o: (F.length(o["id"]) > 0) & (F.length(o["name"]) > 0) & o["priced"])
    return F.transform(kept, lambda o: F.struct(o["id"].alias("id"), o["name"].alias("name"),
                                                o["price"].alias("price")))


def asks(ticker: Column, yes_ask: Column, no_ask: Column, volume: Column) -> Column:
    """Binary outcomes with derived ids, priced at the ask."""
    def side(tag: str, name: str, ask: Column) -> Column:
        return F.struct(F.concat(ticker, F.lit(f"-{tag}")).alias("id"), F.lit(name).alias("name"),
                        F.coalesce(prices.number(ask), F.lit(0.0)).alias("price"),
                        F.coalesce(prices.number(volume), F.lit(0.0)).alias("volume"))
    return F.array(side("yes", "Yes", yes_ask), side("no", "No", no_ask))


def _outcome(name: Column, price: Column, volume: Column) -> Column:
    return F.struct(name.alias("name"), price.alias("price"), volume.alias("volume"),
                    price.cast("double").alias("probability"))


def yes_no(yes: Column, yes_volume: Column, no_volume: Column) -> Column:
    """Yes at a normalized price, No at its complement, with normalized volumes."""
    no = (F.lit("1").cast("decimal(18,4)") - yes).cast("decimal(18,4)")
    return F.array(_outcome(F.lit("Yes"), yes, yes_volume), _outcome(F.lit("No"), no, no_volume))


def listed(outcomes_json: Column) -> Column:
    """Explicit outcome objects; NULL when the text holds none."""
    parsed = F.from_json(outcomes_json, "array<struct<name:string,price:string,volume:string>>")
    return F.transform(parsed, lambda o: _outcome(
        F.coalesce(o["name"], F.lit("Unknown")),
        prices.normalize_price(F.coalesce(o["price"], F.lit("0.5"))),
        prices.normalize_volume(F.coalesce(o["volume"], F.lit("0")))))


def yes_price(outcomes: Column) -> Column:
    """Price of the outcome named like Yes, else of the first one, else 0.5."""
    known = string_array(YES_NAMES)
    named = F.filter(outcomes, lambda o: F.array_contains(known, F.lower(o["name"])))
    return F.coalesce(F.try_element_at(named, F.lit(1))["price"].cast("double"),
                      F.try_element_at(outcomes, F.lit(1))["price"].cast("double"), F.lit(0.5))


def liquidity(outcomes: Column, volume: Column) -> Column:
    """Mean outcome volume, discounted by the price spread, never above the market volume."""
    total = F.aggregate(outcomes, F.lit("0").cast("decimal(28,2)"),
                        lambda acc, o: (acc + o["volume"]).cast("decimal(28,2)"))
    quoted = F.transform(outcomes, lambda o: o["price"])
    spread = (F.array_max(quoted) - F.array_min(quoted)).cast("double")
    factor = F.when(F.size(outcomes) >= 2, F.greatest(F.lit(0.1), F.lit(1.0) - spread)).otherwise(0.5)
    mean = total.cast("double") / F.size(outcomes)
    value = F.bround((mean * factor).cast("decimal(28,8)"), 2).cast("decimal(18,2)")
    return F.when(F.size(outcomes) == 0, F.lit("0").cast("decimal(18,2)")).otherwise(
        F.least(value, volume.cast("decimal(18,2)")))
