"""Reading evaluation replies: JSON objects inside prose, and one line per pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_REPLY = ("confidence_score string, reasoning string, semantic_similarity string, "
              "arbitrage_viability string, risk_assessment string, recommended_action string")
NO_REASONING = "No reasoning provided"


def json_reply(text: Column) -> Column:
    """Struct from the outermost braces of a reply; a middling fallback when unreadable."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    # A permissive parse of malformed text gives an all-NULL struct, so check the JSON first.
    readable = (F.length(body) > 0) & F.json_object_keys(body).isNotNull()
    parsed = F.from_json(body, JSON_REPLY)

    def pick(name: str, missing: Column, fallback: Column, cast: str | None = None) -> Column:
        value = parsed[name].try_cast(cast) if cast else parsed[name]
        return F.when(readable, F.coalesce(value, missing)).otherwise(fallback).alias(name)

    return F.struct(
        pick("confidence_score", F.lit(0.0), F.lit(0.5), "double"),
        pick("reasoning", F.lit(NO_REASONING), F.substring(text, 1, 500)),
        pick("semantic_similarity", F.lit(0.0), F.lit(0.5), "double"),
        pick("arbitrage_viability", F.lit(0.0), F.lit(0.5), "double"),
        pick("risk_assessment", F.lit("No risk assessment"),
             F.lit("Unable to parse structured response")),
        pick("recommended_action", F.lit("REJECT"), F.lit("INVESTIGATE")),
        readable.alias("readable"))


def line_confidence(line: Column) -> Column:
    found = F.regexp_extract(line, r"confidence=([0-9.]+)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def line_reasoning(line: Column) -> Column:
    found = F.regexp_extract(line, r'reasoning="([^"]+)"', 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_REASONING))
