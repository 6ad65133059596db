"""Reading venue dates and measuring distances between close times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossmarket.config import NormalizationConfig
from crossmarket.functions import vocab


def as_timestamp(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def parse_date(text: Column, as_of: str | Column,
               cfg: NormalizationConfig = NormalizationConfig()) -> Column:
    """Accepted layouts in order (month-first before day-first), epoch seconds, range-checked."""
    attempts = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in vocab.DATE_FORMATS]
    epoch = F.when(text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(text.try_cast("long")))
    parsed = F.coalesce(*attempts, epoch)
    now = as_timestamp(as_of)
    low = now - F.make_dt_interval(F.lit(cfg.past_days))
    high = now + F.make_dt_interval(F.lit(cfg.future_days))
    return F.when(parsed.between(low, high), parsed)


def parse_iso(text: Column, default: Column | None = None) -> Column:
    """ISO-8601 with an optional Z; unreadable or missing gives the default."""
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'")),
                        F.try_to_timestamp(text))
    return parsed if default is None else F.coalesce(parsed, default)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def seconds_apart(left: Column, right: Column) -> Column:
    return F.abs(epoch(left) - epoch(right))


def hours_apart(left: Column, right: Column) -> Column:
    return seconds_apart(left, right) / 3600


def closing_soon(close: Column, as_of: str, hours: int, inclusive: bool = False) -> Column:
    """Less than the given hours to close; true for markets closed already."""
    return epoch_soon(epoch(close), as_of, hours, inclusive)


def epoch_soon(close: Column, as_of: str, hours: int, inclusive: bool = False) -> Column:
    """`closing_soon` of a close time in epoch seconds."""
    left = close - epoch(as_timestamp(as_of))
    return left <= hours * 3600 if inclusive else left < hours * 3600


def alignment_score(apart: Column, max_days: int, both_soon: Column) -> Column:
    """1 at equal close times, 0 at the limit of seconds apart, +0.2 (at most 1) when both close soon."""
    base = F.lit(1.0) - apart / float(max_days * 24 * 3600)
    return F.when(both_soon, F.least(F.lit(1.0), base + 0.2)).otherwise(base)
