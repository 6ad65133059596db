"""The pair step's arithmetic against the plain forms it replaces."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from crossmarket.functions import prices, text
from crossmarket.operators import staged_filter


def test_on_grid_is_round(spark):
    chance = random.Random(7)
    values = [k / 2_000_000 for k in range(-2001, 2002)] + [chance.uniform(-1, 1) * 10 ** chance.randint(-8, 14) for _ in range(4000)]
    values += [0.0, -0.0, -1e-9, 0.1 + 0.2, 1.005, 4000.0000005, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (6, 9):
        bad = df.where(~prices.on_grid(F.col("v"), digits).eqNullSafe(F.round("v", digits))).collect()
        assert not bad, bad[:5]
    tied = F.round(F.col("v").cast("decimal(38,9)"), 6).cast("double")
    assert df.where(F.abs("v") < 1e20).where(~prices.on_grid(F.col("v"), 6, tied).eqNullSafe(tied)).count() == 0


def test_bounds_without_rounding(spark):
    import math
    near = [0.0199995, 0.0299995, 0.0999995, 0.02, 0.03, 0.1]
    values = [f(v) for v in near for f in (float, lambda v: math.nextafter(v, 0), lambda v: math.nextafter(v, 1))]
    values += [k / 10_000_000 for k in range(199_000, 201_000)]
    a, b = F.col("v"), F.lit(0.0)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rounded = F.round(F.abs(a - b), 6)
    for bound in (0.02, 0.0200004, 0.1):
        assert df.where(prices.gap_reaches(a, b, bound) != (rounded >= bound)).count() == 0
    net = F.greatest(F.round(rounded - 0.01, 6), F.lit(0.0))
    assert df.where(prices.net_gap_reaches(a, b, 0.01, 0.02) != (net >= 0.02)).count() == 0


def coded_pairs(spark, titles):
    rows = [(f"{v}{i}", v, "c", t, "Sports", 0.5, 500.0, "2001-01-01 00:00:00") for v in ("kalshi", "polymarket")
            for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id string, platform string, bucket string, title string, category string, yes_price double, "
                                     "volume double, close_time string").withColumn("close_time", F.col("close_time").cast("timestamp_ntz"))
    k, p = (staged_filter.side(df, v, ["bucket"]) for v in ("kalshi", "polymarket"))
    plain = k.join(p, "bucket").select("kalshi_id", "polymarket_id",
                                       F.size(F.array_intersect("kalshi_tokens", "polymarket_tokens")).alias("n"))
    a, b = staged_filter.coded(k, p)
    return plain, staged_filter.with_shared_tokens(a.join(b, "bucket")).select(
        "kalshi_id", "polymarket_id", F.col("shared_tokens").cast("int").alias("n")), a


def test_shared_words_by_bits(spark):
    """More words than bits, so that some are held as arrays; the same counts as by intersection."""
    chance = random.Random(3)
    words = [f"w{i}" for i in range(64 * text.BIT_COLUMNS * 2)]
    titles = [" ".join(chance.choices(words[:40], k=4) + chance.choices(words, k=5)) for _ in range(150)] + ["", "w0", "the of", words[-1]]
    plain, got, a = coded_pairs(spark, titles)
    assert sorted(plain.collect()) == sorted(got.collect())
    assert a.where("kalshi_rest IS NOT NULL").count() > 0 and a.where("kalshi_rest IS NULL").count() > 0


def test_pairs_compare_no_arrays_of_frequent_words(spark):
    _, got, a = coded_pairs(spark, ["bitcoin above ten", "bitcoin below ten"])
    assert "kalshi_tokens" not in a.columns and a.where("kalshi_rest IS NOT NULL").count() == 0


def test_long_stages_are_split(spark):
    from crossmarket.plans import registry
    next(iter(__import__("__spark_entry__").queries().values()))(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(registry.METHOD_LIMIT)) <= 8000


def test_selected_legs_derive_their_listings_once(spark):
    """The driver gathers no listings for a broadcast, and the pair joins read the ones written."""
    from crossmarket.sources import derived
    root = "/root/testdata/sf0.001"
    plan = __import__("__spark_entry__").queries()["d14_selected_legs"](spark, root)._jdf.queryExecution()
    assert "l_partkey" not in plan.optimizedPlan().toString()
    assert "BroadcastHashJoin" not in derived.markets(spark, root)._jdf.queryExecution().sparkPlan().toString()
