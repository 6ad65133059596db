"""Prices, volumes, liquidity and cost arithmetic as Column expressions."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossmarket.config import NormalizationConfig


def number(value: Column) -> Column:
    return value.try_cast("double")


def positive(value: Column) -> Column:
    """The value when above zero, else NULL (zero counts as missing)."""
    return F.when(number(value) > 0, number(value))


def or_default(value: Column, default: float) -> Column:
    """Missing and zero both become the default."""
    return F.coalesce(F.nullif(number(value), F.lit(0.0)), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d.]", "")


def to_decimal(value: Column, numeric: bool) -> Column:
    """Exact decimal of a number, or of the digits in a text."""
    return (value if numeric else digits(value)).try_cast("decimal(28,10)")


def normalize_price(price: Column, numeric: bool = False,
                    cfg: NormalizationConfig = NormalizationConfig()) -> Column:
    """Price to DECIMAL(18,4): half-even, clamped; unreadable is the default."""
    value = to_decimal(price, numeric)
    low, high = (F.lit(str(v)).cast("decimal(18,4)") for v in (cfg.min_price, cfg.max_price))
    rounded = F.bround(value, 4).cast("decimal(18,4)")
    return (F.when(value.isNull(), F.lit(str(cfg.default_price)).cast("decimal(18,4)"))
            .when(value < low, low).when(value > high, high).otherwise(rounded))


def normalize_volume(volume: Column, numeric: bool = False) -> Column:
    """Volume to DECIMAL(18,2): non-negative, half-even; unreadable is zero."""
    value = to_decimal(volume, numeric)
    zero = F.lit("0").cast("decimal(18,2)")
    return F.coalesce(F.greatest(F.bround(value, 2).cast("decimal(18,2)"), zero), zero)


def cents_to_share(price: Column) -> Column:
    return F.when(price > 1, price / 100).otherwise(price)


def quoted_price(bid: Column, ask: Column, last: Column, side: str, *, cents: bool = False,
                 one_sided: bool = False) -> Column:
    """Midpoint of a proper quote, else last trade, else (optionally) one side, else 0.5."""
    bid, ask, last = (F.coalesce(number(c), F.lit(0.0)) for c in (bid, ask, last))
    share = cents_to_share if cents else (lambda c: c)
    traded = share(last) if side == "yes" else F.lit(1.0) - share(last)
    chain = (F.when((bid > 0) & (ask > 0) & (ask > bid), (share(bid) + share(ask)) / 2)
             .when(last > 0, traded))
    if one_sided:
        chain = chain.when(ask > 0, share(ask)).when(bid > 0, share(bid))
    return chain.otherwise(F.lit(0.5))


def asked_price(ask: Column, price: Column, last: Column) -> Column:
    """Ask, else price, else last trade, else 0.5; clamped to [0, 1]."""
    chosen = F.coalesce(positive(ask), positive(price), positive(last), F.lit(0.5))
    return clamp(chosen, 0.0, 1.0)


def asked_no_price(no_ask: Column, no_price: Column, yes_ask: Column, yes_price: Column) -> Column:
    yes = F.coalesce(positive(yes_ask), positive(yes_price), F.lit(0.5))
    return clamp(F.coalesce(positive(no_ask), positive(no_price), F.lit(1.0) - yes), 0.0, 1.0)


def traded_price(last: Column, bid: Column, ask: Column) -> Column:
    """Last trade, else quote midpoint, else 0.5; clamped to [0, 1]."""
    midpoint = (number(bid) + number(ask)) / 2
    return clamp(F.coalesce(number(last), midpoint, F.lit(0.5)), 0.0, 1.0)


def lenient_traded_price(last: Column, bid: Column, ask: Column) -> Column:
    """As traded_price, but a zero last trade reads as 0.5 and bad quotes as 0 and 1."""
    midpoint = (or_default(bid, 0.0) + or_default(ask, 1.0)) / 2
    return (F.when(last.isNotNull(), or_default(last, 0.5))
            .when(bid.isNotNull() & ask.isNotNull(), midpoint).otherwise(F.lit(0.5)))


def volume_proxy(volume: Column, open_interest: Column, liquidity: Column, strategy: str) -> Column:
    """Volume where the venue reports none.

    strategy: "chain" = volume, open interest, liquidity/1000; "if_zero" = liquidity/1000 when
    volume is zero; "always" = liquidity/1000.
    """
    scaled = F.coalesce(number(liquidity), F.lit(0.0)) / 1000
    if strategy == "always":
        return scaled
    if strategy == "if_zero":
        return F.when((number(volume) == 0) & (number(liquidity) > 0), scaled).otherwise(number(volume))
    if strategy == "chain":
        return F.coalesce(positive(volume), positive(open_interest).cast("long").cast("double"),
                          F.when(scaled > 0, scaled), F.lit(0.0))
    raise ValueError(f"unknown volume strategy: {strategy}")


def liquidity_score(volume: Column, price: Column) -> Column:
    """log10 of volume discounted away from an even price, scaled to [0, 1]."""
    weight = F.greatest(F.lit(0.1), F.lit(1.0) - F.abs(price - 0.5) * 2)
    adjusted = volume * weight
    return F.when(adjusted <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.log10(adjusted + 1) / 4))


def volume_ratio(left: Column, right: Column) -> Column:
    longest = F.greatest(left, right)
    return F.when(longest > 0, F.least(left, right) / longest).otherwise(F.lit(0.0))


def on_grid(value: Column, digits: int = 6, rounded: Column | None = None) -> Column:
    """The same as F.round of a double (or another `rounded`), which works in decimals.

    Decimals are slow; they are left to values near a half step, and to large ones.
    """
    scaled = value * F.lit(10.0 ** digits)
    step = F.rint(scaled)
    clear = (F.abs(scaled) <= 4e9) & (F.abs(scaled - step) < 0.49)
    return F.when(clear, (step + 0.0) / F.lit(10.0 ** digits)).otherwise(
        F.round(value, digits) if rounded is None else rounded)


def least_rounding_to(bound: float, digits: int = 6) -> float:
    """The smallest double that F.round takes to `bound` or more."""
    steps = (Decimal(repr(bound)) * 10 ** digits).to_integral_value(ROUND_CEILING)
    return float((steps - Decimal("0.5")) / 10 ** digits)


def gap(left: Column, right: Column) -> Column:
    """Absolute price difference on the 1e-6 grid (prices have at most four decimals)."""
    return on_grid(F.abs(left - right))


def gap_reaches(left: Column, right: Column, bound: float) -> Column:
    """gap(left, right) >= bound for a positive bound, without rounding every pair."""
    return F.abs(left - right) >= F.lit(least_rounding_to(bound))


def net_gap(difference: Column, fee: float, floor: bool = True) -> Column:
    net = on_grid(difference - F.lit(fee))
    return F.greatest(net, F.lit(0.0)) if floor else net


def net_gap_reaches(left: Column, right: Column, fee: float, bound: float) -> Column:
    """net_gap(gap(left, right), fee) >= bound for a positive bound; also without rounding if the fee is on the grid."""
    if Decimal(repr(fee)) * 10 ** 6 % 1:
        return net_gap(gap(left, right), fee) >= bound
    steps = (Decimal(repr(bound)) * 10 ** 6).to_integral_value(ROUND_CEILING)
    return gap_reaches(left, right, float(steps / 10 ** 6 + Decimal(repr(fee))))


def risk_adjusted(profit: Column, min_volume: Column, divisor: float,
                  confidence: Column | None = None) -> Column:
    scaled = profit if confidence is None else profit * confidence
    return scaled * F.log10(min_volume + 1) / divisor
