"""Hand-made rows for the decisions a table of regular data does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crossmarket.config import ArbitrageConfig, BucketConfig, FilterConfig
from crossmarket.functions import categories, dates, outcomes, prices, replies, text
from crossmarket.functions.vocab import Bucket
from crossmarket.operators import arbitrage, buckets, candidates, groups, pairing, similarity_join, tables
from crossmarket.sources.derived import AS_OF


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bucket_fold_is_order_dependent(spark):
    strong = Bucket("strong", ("alpha", "beta"), ("A",), 4)
    boosted = Bucket("boosted", ("alpha", "gamma", "delta"), ("A",), 1)
    df = spark.createDataFrame([("alpha beta", None, "A", None, None)],
                               "title string, description string, category string, close_time timestamp, open_time timestamp")
    row = buckets.with_bucket(df, BucketConfig(), (strong, boosted)).first()
    # strong has 80 points, boosted 56.67 plus a boost of 20: 76.67 does not displace 80.
    assert row.bucket == "strong"
    row = buckets.with_bucket(df.withColumn("title", F.lit("alpha")), BucketConfig(), (strong, boosted)).first()
    # strong 70; boosted 56.67 + 20 = 76.67 wins and only 56.67 is stored.
    assert row.bucket == "boosted" and row.bucket_confidence == pytest.approx(0.5667, abs=1e-3)


def test_required_keyword_vetoes_and_substrings_match(spark):
    df = spark.createDataFrame([("maga republican nominee gop nominee", None, "Politics", None, None),
                                ("Whether paid said", None, "Technology", None, None)],
                               "title string, description string, category string, close_time timestamp, open_time timestamp")
    got = [r.bucket for r in buckets.with_bucket(df).collect()]
    assert got == ["miscellaneous", "tech_ai"]


def test_dates_try_layouts_in_order(spark):
    rows = [("2001-03-04T05:06:07.890Z",), ("2001-03-04 05:06:07",), ("03/04/2001",), ("25/12/2000",), ("1000000000",),
            ("",), ("garbage",), ("1950-01-01",)]
    got = values(spark, dates.parse_date(F.col("d"), AS_OF), rows, "d string")
    assert got == [dt.datetime(2001, 3, 4, 5, 6, 7, 890000), dt.datetime(2001, 3, 4, 5, 6, 7), dt.datetime(2001, 3, 4),
                   dt.datetime(2000, 12, 25), dt.datetime(2001, 9, 9, 1, 46, 40), None, None, None]


def test_price_and_volume_text(spark):
    rows = [("$0.45",), ("45",), ("0.00001",), ("abc",), ("0.12345",), ("0.12355",), (None,)]
    got = [float(v) for v in values(spark, prices.normalize_price(F.col("p")), rows, "p string")]
    assert got == [0.45, 0.9999, 0.0001, 0.5, 0.1234, 0.1236, 0.5]
    got = [float(v) for v in values(spark, prices.normalize_volume(F.col("p")), [("$1,234.565",), ("x",)], "p string")]
    assert got == [1234.56, 0.0]


def test_clean_text_limits(spark):
    rows = [("a  b\tc",), ("x" * 210,), ("word " * 60,), ("café ☃",), (None,)]
    got = values(spark, text.clean_text(F.col("t"), 200), rows, "t string")
    assert got[0] == "a b c" and got[1] == "x" * 200 + "..." and got[4] == ""
    assert got[2].endswith("word...") and len(got[2]) <= 203 and got[3] == "caf "


def test_similarity_edges(spark):
    rows = [("", "a"), ("the of", "a to"), ("red fox", "red fox"), ("red", "blue")]
    got = values(spark, text.title_jaccard(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got == [0.0, 0.0, 1.0, 0.0]
    low = values(spark, text.containment_ratio(F.col("a"), F.col("b")), [("abcdefgh", "zyxwvuts")], "a string, b string")
    assert low == [-1.0]


def test_outcome_names_and_zipping(spark):
    rows = [('["YES","x","y"]',), ('["a","b"]',), ('["a"]',), ("nope",), (None,)]
    assert values(spark, outcomes.is_binary(F.col("o")), rows, "o string") == [True, True, False, False, False]
    zipped = values(spark, outcomes.zipped(F.col("n"), F.col("p"), F.col("i")),
                    [('["Yes","No"]', '["0.4"]', '["t1","t2"]')], "n string, p string, i string")[0]
    assert [(o["id"], o["name"], o["price"]) for o in zipped] == [("t1", "Yes", 0.4)]


def test_category_repairs_first_and_last(spark):
    row = [("bitcoin election", None, "other")]
    schema = "t string, d string, c string"
    assert values(spark, categories.repaired_first(F.col("c"), F.col("t"), F.col("d")), row, schema) == ["politics"]
    assert values(spark, categories.repaired_last(F.col("c"), F.col("t")), row, schema) == ["politics"]
    assert values(spark, categories.repaired_last(F.col("c"), F.col("t")), [("trump bitcoin", None, "x")], schema) == ["politics"]


def test_json_replies(spark):
    rows = [('ok {"confidence_score": 0.8, "reasoning": "r"} end',), ("no braces",), ("{broken",), ('{"reasoning": "only"}',)]
    got = [(r["confidence_score"], r["recommended_action"]) for r in
           values(spark, replies.json_reply(F.col("t")), rows, "t string")]
    assert got == [(0.8, "REJECT"), (0.5, "INVESTIGATE"), (0.5, "INVESTIGATE"), (0.0, "REJECT")]


def test_position_size_and_risk_gate(spark):
    rows = [(0.0, 1000.0, 900.0), (0.25, 1e6, 1e6), (0.26, 1e6, 1e6), (0.9, 1e6, 1e6), (0.9, 0.0, 10.0)]
    got = values(spark, arbitrage.position_size(ArbitrageConfig()), rows,
                 "price_difference double, kalshi_volume double, polymarket_volume double")
    assert got[0] is None and got[1] == 0.0 and got[2] == pytest.approx(307.69) and got[3] == 2500.0 and got[4] == 0.0
    levels = [("very_low",), ("low",), ("medium",), ("high",), ("very_high",)]
    gate = lambda g: values(spark, arbitrage.risk_allowed(F.col("l"), ArbitrageConfig(risk_gate=g)), levels, "l string")
    assert gate("ordinal") == [True, True, True, False, False]
    assert gate("literal") == [False, True, True, True, False]


def test_hot_key_is_sliced_without_losing_pairs(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("key"),
                                   F.col("id").alias("a"))
    right = left.withColumnRenamed("a", "b")
    got = pairing.slice_join(left, right, ["key"], "a", "b", F.col("a") < F.col("b"), budget=400)
    assert got.count() == 200 * 199 // 2 and got.distinct().count() == got.count()


def test_listings_without_a_price_push_no_pair_out(spark):
    """Thirty listings without a price beside one good pair: the widest-gap searches still find the pair."""
    def row(i, venue, price, volume):
        return (f"{venue}-{i}", venue, "Rain tomorrow", "Weather", "weather", price, volume, True)

    rows = [row(i, v, None, 9e6) for i in range(30) for v in ("kalshi", "polymarket")]
    rows += [row(99, "kalshi", 0.2, 5000.0), row(99, "polymarket", 0.6, 5000.0)]
    df = spark.createDataFrame(rows, "id string, platform string, title string, category string, bucket string, "
                                     "yes_price double, volume double, is_active boolean")
    found = (candidates.category_or_keyword_pairs(df), candidates.same_key_pairs(df, "category", 10, 0.05, 100.0),
             candidates.first_word_matches(df))
    for pairs in found:
        assert [(r.kalshi_id, r.polymarket_id) for r in pairs.collect()] == [("kalshi-99", "polymarket-99")]


def test_prefix_join_equals_brute_force(spark):
    words = "a b c d e f g h".split()
    rows = [(i, [words[j] for j in range(8) if (i * 37 >> j) & 1]) for i in range(1, 120)]
    rows = [(i, s) for i, s in rows if s]
    df = spark.createDataFrame(rows, "x bigint, s array<string>").withColumn("k", F.lit(1))
    other = df.withColumnsRenamed({"x": "y", "s": "t"})
    alike = text.jaccard(F.col("s"), F.col("t")) >= 0.6
    got = similarity_join.prefix_join(df, other, ["k"], ("x", "y"), ("s", "t"), similarity_join.jaccard_prefix(0.6),
                                      alike, budget=500).select("x", "y")
    want = {(i, j) for i, a in rows for j, b in rows if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    found = [(r.x, r.y) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_contained_titles_equals_brute_force(spark):
    texts = [f"alpha {i % 7} beta {i % 5} gamma" for i in range(40)] + ["beta 1 gamma", "alpha 3 beta", "zzzzzzzz"]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    got = similarity_join.contained_titles(df, "n", df.withColumnRenamed("n", "h"), "h", 6)
    assert {tuple(r) for r in got.select("n", "h").collect()} == {(a, b) for a in texts for b in texts if a in b}


def test_components_merge_chains_and_are_idempotent(spark):
    edges = [(f"k{i}", f"k{i + 1}", 0.9) for i in range(40)] + [("x", "y", 0.9), ("y", "z", 0.8), ("u", "v", 0.2)]
    df = spark.createDataFrame(edges, "kalshi_id string, polymarket_id string, confidence_score double")
    got = {r.market_id: r.group_id for r in groups.match_groups(df).collect()}
    assert {got[f"k{i}"] for i in range(41)} == {"k0"} and {got["x"], got["y"], got["z"]} == {"x"} and "u" not in got


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double")
    source = spark.createDataFrame([(2, 5.0, 1), (2, 6.0, 2), (3, 7.0, 1)], "id int, v double, version int")
    once = tables.upsert(target, source, ["id"], ["version"], ["v"])
    assert {tuple(r) for r in once.collect()} == {(1, 1.0, "kept"), (2, 6.0, "updated"), (3, 7.0, "inserted")}
    again = tables.upsert(once.drop("action"), source, ["id"], ["version"], ["v"])
    assert {tuple(r)[:2] for r in again.collect()} == {tuple(r)[:2] for r in once.collect()}


def test_filter_config_is_the_threshold(spark):
    assert FilterConfig().min_gap < FilterConfig().big_gap
    df = spark.createDataFrame([("a", "kalshi"), ("b", "polymarket")], "id string, platform string")
    assert candidates.selected_pairs(df.withColumn("title", F.lit("t")), df).count() == 1
