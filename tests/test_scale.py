"""Operators that count, index or split instead of pairing or gathering: equal to brute force, and bounded where rows are hot."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crossmarket.config import ModelConfig
from crossmarket.functions import text, vocab
from crossmarket.operators import (angle_index, arbitrage, box_counts, candidates, enrich, groups, intervals, model, ranks, score_floor, scoring,
                                   similarity_join, staged_filter)
from crossmarket.operators.scoring import FEATURES
from crossmarket.streaming import metrics

LISTING = ("id string, platform string, title string, category string, yes_price double, volume double, liquidity double, "
           "title_normalized string, title_hash string, is_active boolean")


def listings(spark, n, categories, words, seed, volumes=(51, 30_000)):
    chance = random.Random(seed)
    rows = [(f"{v}{i}", v, " ".join(chance.choices(words, k=2)), chance.choice(categories), chance.randint(500, 9500) / 10_000,
             round(math.exp(chance.uniform(*map(math.log, volumes))), 2), 1.0, "", "", True)
            for v in ("kalshi", "polymarket") for i in range(n)]
    return rows, spark.createDataFrame(rows, LISTING)


def score(k, p):
    gap, low = round(abs(k[4] - p[4]), 6), min(k[5], p[5])
    shared = next((s for w, s in vocab.SCORE_KEYWORDS if w in k[2] and w in p[2]), 0)
    return ((50 if k[3] is not None and k[3] == p[3] else 0) + shared + next((s for s, b in ((25, .15), (20, .1), (15, .05)) if gap > b), 0)
            + next((s for s, b in ((15, 10_000), (10, 1000), (5, 100)) if low > b), 0))


@pytest.mark.parametrize("categories,words,k", [(("A", "B", None), ("trump", "fed", "china", "sun", "rain"), 60),
                                                (("A",), ("sun", "rain"), 40), (tuple("ABCDEFGHIJKLMNOP"), ("sun",), 5000)])
def test_top_scored_pairs_against_all_pairs(spark, categories, words, k):
    rows, df = listings(spark, 120, categories, words, k)
    every = [(score(a, b), min(a[5], b[5]), max(a[5], b[5]), a[0], b[0]) for a in rows if a[1] == "kalshi"
             for b in rows if b[1] == "polymarket"]
    want = sorted((-s, -lo, -hi, a, b) for s, lo, hi, a, b in every if s >= 30)[:k]
    got = candidates.top_scored_pairs(df, k).select("similarity_score", "kalshi_id", "polymarket_id").collect()
    assert [tuple(r) for r in got] == [(-s, a, b) for s, _, _, a, b in want]


def test_top_scored_pairs_form_few_pairs(spark):
    """Thousands of distinct prices, one category, one keyword: nine million pairs, of which some hundreds are formed."""
    _, df = listings(spark, 3000, ("A",), ("trump",), 1)
    sides = [candidates.renamed(df, v, ("id", "yes_price", "volume", "title", "category")).select(
        "*", F.col(f"{v}_category").alias("_category"), F.col(f"{v}_price").alias("_price"), F.col(f"{v}_volume").alias("_volume"),
        F.array(F.lit("trump")).alias("_words")) for v in ("kalshi", "polymarket")]
    formed = score_floor.reachable_pairs(*sides, 200, 30, candidates.gap_column()).count()
    assert 200 <= formed < 2000


def test_far_intervals_tile_exactly_the_far_cells(spark):
    cells = spark.range(128).select(F.col("id").cast("int").alias("cell"))
    near = {r.cell: set(r.x) for r in cells.select("cell", score_floor.around(F.col("cell")).alias("x")).collect()}
    for distance in (4, 14):
        for r in cells.select("cell", score_floor.apart(F.col("cell"), distance).alias("x")).collect():
            met = {c: len(near[c] & set(r.x)) for c in near}
            assert met == {c: int(abs(c - r.cell) >= distance) for c in near}


@pytest.fixture(scope="module")
def clusters(spark):
    chance = np.random.default_rng(3)
    centres = chance.normal(size=(12, 16))
    rows = [(i, "ab"[i % 12 > 8], [float(x) for x in centres[i % 12] + chance.normal(size=16) * 0.25]) for i in range(600)]
    rows += [(900, "a", [0.0] * 16), (901, "a", None), (902, "a", rows[0][2]), (903, "c", rows[0][2])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")


def test_angle_pairs_against_all_pairs(clusters):
    rows, df = clusters
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v and any(v)}
    label = {i: g for i, g, _ in rows}
    want = {(i, j) for i in unit for j in unit if i < j and label[i] == label[j] and unit[i] @ unit[j] >= 0.7}
    got = {(r.left_id, r.right_id) for r in candidates.embedding_pairs(df).collect()}
    assert got == want and len(want) > 5000
    compared = angle_index.angle_candidates(df, "label", "vec_id", "embedding", 0.7, 16).count()
    every = sum(n * (n - 1) // 2 for n in (451, 150))
    assert len(want) <= compared < every / 3


def test_vectors_meet_in_parts_of_bounded_size(clusters):
    rows, df = clusters
    whole = {(r.left_id, r.right_id, round(r.similarity, 9)) for r in angle_index.block_pairs(df, "label", "vec_id", "embedding", 0.7).collect()}
    for size in (7, 100):
        found = angle_index.block_pairs(df, "label", "vec_id", "embedding", 0.7, size).collect()
        assert {(r.left_id, r.right_id, round(r.similarity, 9)) for r in found} == whole and len(found) == len(whole) > 5000
        assert all(r.left_id < r.right_id for r in found)


def test_median_and_auc(spark):
    chance = random.Random(2)
    for n in (1, 2, 501, 1000):
        values = [chance.randint(0, 300) / 7 for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        assert ranks.median(df, "x", 5).first()[0] == pytest.approx(float(np.median(values)))
    assert ranks.median(df.limit(0), "x").first()[0] is None
    rows = [(chance.randint(0, 40) / 40, float(chance.random() < 0.4)) for _ in range(800)]
    won = sum((a > b) + 0.5 * (a == b) for a, p in rows if p for b, q in rows if not q)
    pairs = sum(1 for _, p in rows if p) * sum(1 for _, q in rows if not q)
    scored = spark.createDataFrame(rows, "worthiness double, label double")
    assert ranks.rank_auc(scored, slices=4).first()[0] == pytest.approx(won / pairs)
    assert ranks.rank_auc(scored.where("label = 1")).first()[0] is None


def test_one_hot_series_is_spread(spark):
    chance = random.Random(4)
    rows = [(i, "m", "yes", chance.choice([0.1, 0.2, None]), chance.randint(0, 2000)) for i in range(6000)]
    rows += [(10_000 + i, f"n{i % 50}", None, 0.1 * (i % 3), i) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id bigint, market_id string, outcome string, price double, t int").withColumn(
        "timestamp", F.timestamp_seconds("t"))
    series = Window.partitionBy("market_id", "outcome").orderBy("timestamp", "event_id")
    plain = df.withColumn("previous_price", F.lag("price").over(series)).where("previous_price IS NULL OR price <> previous_price")
    pick = lambda d: sorted(map(tuple, d.select("event_id", "price", "previous_price").collect()), key=str)
    assert pick(enrich.price_changes(df, slices=16)) == pick(plain)
    sizes = [r["count"] for r in ranks.in_slices(df, ["market_id", "outcome", "timestamp", "event_id"], 16).groupBy("_slice").count().collect()]
    assert max(sizes) < len(rows) / 5


def test_a_hub_is_split(spark):
    star = spark.range(20_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("bigint").alias("v"))
    edges = star.unionByName(spark.createDataFrame([(30_000, 30_001), (30_001, 7), (40_000, 40_001)], "u bigint, v bigint"))
    found = {r.node: r.component for r in groups.connected_components(edges, "u", "v").collect()}
    assert len(found) == 20_005 and {found[i] for i in range(20_001)} == {0} and found[30_000] == 0 and found[40_001] == 40_000
    split = groups._split(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    assert split.groupBy("u", "_part").count().agg(F.max("count")).first()[0] < 20_000 / 100


def test_model_scores_and_measures(spark):
    chance = random.Random(8)
    made = []
    for i in range(600):
        label = float(chance.random() < 0.4)
        made.append((f"k{i}", f"p{i}", *[min(1.0, max(0.0, chance.gauss(0.35 + 0.3 * label, 0.25))) for _ in FEATURES], label))
    schema = "kalshi_id string, polymarket_id string, " + ", ".join(f"{c} double" for c in FEATURES) + ", label double"
    rows = spark.createDataFrame(made, schema)
    cfg = ModelConfig(kind="random_forest")
    train_rows, test_rows = model.split(rows, cfg)
    fitted = model.train(train_rows, cfg)
    scores = model.predict(fitted, test_rows)
    for r in scores.select("worthiness", "confidence_prediction", "prediction").collect():
        assert 0 <= r.worthiness <= 1 and r.confidence_prediction == pytest.approx(min(0.9, r.worthiness + 0.1))
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0)
    assert model.roc_auc(scores) == pytest.approx(evaluator.evaluate(scores), abs=0.01)
    measured = {r.measure: r.value for r in model.quality(fitted, train_rows, test_rows, cfg).collect()}
    assert measured["held_out_roc_auc"] > 0.8 and measured["held_out_accuracy"] > 0.7
    assert sum(v for m, v in measured.items() if m.startswith("importance_")) == pytest.approx(1.0)
    assert measured["cross_validated_accuracy"] > 0.7 and measured["replaced_by_retraining"] == 0.0
    nothing = {r.measure: r.value for r in model.quality(None, train_rows.limit(5), test_rows.limit(5), cfg).collect()}
    assert nothing["fitted"] == 0.0 and nothing["held_out_roc_auc"] is None and nothing["importance_volume_ratio"] is None


def test_legs_of_a_hot_group_form_few_pairs(spark):
    chance = random.Random(6)
    rows = [(f"m{i}", ("kalshi", "polymarket", "other")[i % 3], chance.randint(50, 99) / 100, chance.randint(48, 99) / 100)
            for i in range(900)]
    df = spark.createDataFrame([(i, p, [("Yes", y), ("No", n)], "g") for i, p, y, n in rows],
                               "id string, platform string, outcomes array<struct<name:string,price:double>>, group_id string")
    want = set()
    for a, pa, ya, na in rows:
        for b, pb, yb, nb in rows:
            if a < b and pa != pb:
                want |= {(a, b, "Yes")} if round(ya + nb, 6) < 1 else set()
                want |= {(a, b, "No")} if round(na + yb, 6) < 1 else set()
    got = {(r.buy_market_id, r.sell_market_id, r.buy_outcome) for r in arbitrage.group_legs(df).collect()}
    assert got == want and 100 < len(want) < 5000
    priced = arbitrage.with_yes_no(df)
    assert arbitrage._cheap_pairs(priced, ["group_id"], 1.0).count() == len(want)
    cells = spark.range(-2, 130).select(F.col("id").cast("int").alias("top"))
    for r in cells.select("top", intervals.up_to(F.col("top")).alias("x")).collect():
        near = [set(x) for x in around_all(spark)]
        assert [len(s & set(r.x)) for s in near] == [int(c <= r.top) for c in range(128)]


def around_all(spark, _kept=[]):
    if not _kept:
        cells = spark.range(128).select(F.col("id").cast("int").alias("cell"))
        _kept.extend(r.x for r in cells.select("cell", intervals.around(F.col("cell")).alias("x")).orderBy("cell").collect())
    return _kept


def test_window_correlation_without_variance(spark):
    """Markets whose mean price never moves, with enough windows and with too few, next to one that moves."""
    rows = [(m, o, day, p) for m, prices in {"flat": [(.5, .2), (.5, .4), (.5, .7)], "short": [(.5, .5), (.5, .5)],
                                             "moving": [(.1, .9), (.2, .8), (.4, .1)]}.items()
            for day, pair in enumerate(prices, 1) for o, p in zip(("view", "click"), pair)]
    history = spark.createDataFrame(rows, "market_id string, outcome string, day int, price double").withColumn(
        "timestamp", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
    got = {r.market_id: r.correlation for r in metrics.window_correlation(history, "view", "click", "1 day").collect()}
    assert set(got) == {"flat", "moving"} and got["flat"] is None
    assert got["moving"] == pytest.approx(np.corrcoef([.1, .2, .4], [.9, .8, .1])[0, 1])


PAIRABLE = ("id string, platform string, title string, category string, bucket string, yes_price double, volume double, "
            "close_time timestamp")


def pairable(spark, n=40):
    chance = random.Random(5)
    words = ("trump", "will", "senate", "the", "win", "is", "fed", "cut", "of", "")
    rows = [(f"{v}-{i}", v, " ".join(chance.choices(words, k=chance.randint(1, 6))), chance.choice(("A", "a", "B")), chance.choice("XY"),
             chance.randint(500, 9500) / 10_000, 100.0 + chance.randint(0, 4000)) for v in ("kalshi", "polymarket") for i in range(n)]
    return spark.createDataFrame([(*r, None) for r in rows], PAIRABLE).withColumn(
        "close_time", F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(4_000_000))))


@pytest.mark.parametrize("name", ["b23_pair_prompts", "c23_worthy_pairs", "f2_best_pairs_per_bucket", "k10_heuristic_worthiness",
                                  "k9_pair_features", "k11_explanations"])
def test_titles_are_not_compared_inside_the_pair_join(spark, name):
    """Filters on scores must not carry the splitting and comparing of titles into the join, where every candidate pays for it."""
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join Inner" in line]
    assert joins and not [line for line in joins if "array_intersect" in line or "split(" in line]


def test_features_of_counted_words_equal_those_of_whole_titles(spark):
    pairs = staged_filter.filter_pairs(pairable(spark), "2001-10-15 00:00:00")
    k, p = text.tokens(F.col("kalshi_title")), text.tokens(F.col("polymarket_title"))
    keys = ["kalshi_id", "polymarket_id"]
    whole = pairs.select(*keys, text.set_cosine(k, p).alias("cosine"), text.overlap_count(k, p).alias("overlap"),
                         (text.title_jaccard(F.col("kalshi_title"), F.col("polymarket_title")) * 0.7).alias("jaccard"))
    found = scoring.with_features(pairs, "2001-10-15 00:00:00").join(whole, keys).select(
        "cosine", "cosine_similarity", "overlap", "keyword_overlap_count", "jaccard", "jaccard_similarity").collect()
    assert len(found) > 50 and len({r.overlap for r in found}) > 2
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in found)
    unmeasured = staged_filter.filter_pairs(pairable(spark), "2001-10-15 00:00:00", measured=False)
    assert {tuple(r) for r in unmeasured.select(keys).collect()} == {tuple(r) for r in pairs.select(keys).collect()}


def test_given_pairs_are_filtered_as_all_pairs_are(spark):
    df, as_of, keys = pairable(spark), "2001-10-15 00:00:00", ["kalshi_id", "polymarket_id"]
    every = df.where("platform = 'kalshi'").select(F.col("id").alias("kalshi_id")).crossJoin(
        df.where("platform = 'polymarket'").select(F.col("id").alias("polymarket_id")))
    given = every.where(F.pmod(F.xxhash64(*keys), F.lit(3)) > 0)
    want = staged_filter.filter_pairs(df, as_of).join(given, keys)
    got = staged_filter.filter_given(given, df, as_of)
    rows = lambda x: sorted(map(str, x.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 30


def test_copies_of_a_title_are_compared_once(spark, monkeypatch):
    """500 listings of six titles: six classes are compared, and all pairs of listings come out."""
    titles = ["fed cut in june", "fed cut june", "the June fed cut", "senate race", "rain", ""]
    rows = [(f"m{i:03}", titles[i % 6], "A" if i % 7 else "B") for i in range(500)] + [("none", "rain", None)]
    compared = []

    def counting(left, *args):
        compared.append(left.count())
        return similarity_join.prefix_join(left, *args)

    monkeypatch.setattr(candidates, "prefix_join", counting)
    got = candidates.similar_within_category(spark.createDataFrame(rows, "id string, title string, category string")).collect()
    sets = {t: frozenset(t.lower().split()) - set(vocab.JACCARD_STOP_WORDS) for t in titles}
    want = {(a[0], b[0], a[2]) for a in rows for b in rows if a[0] < b[0] and a[2] and a[2] == b[2] and sets[a[1]] and
            len(sets[a[1]] & sets[b[1]]) >= 0.7 * len(sets[a[1]] | sets[b[1]])}
    assert {(r.market1_id, r.market2_id, r.category) for r in got} == want and len(got) == len(want)
    assert compared == [6]


def test_selected_pairs_are_dealt_into_even_cells(spark):
    df = spark.range(300).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"))
    got = [(r.market1_id, r.market2_id) for r in candidates.selected_pairs(df, df, edge=40).select("market1_id", "market2_id").collect()]
    ids = [f"m{i}" for i in range(300)]
    assert len(got) == len(set(got)) == 300 * 299 // 2 and set(got) == {(a, b) for a in ids for b in ids if a < b}


def test_training_rows_are_dealt_into_even_files(spark):
    rows = spark.range(4000).selectExpr("concat('k', id) AS kalshi_id", "concat('p', id) AS polymarket_id", "id / 2.0 AS x").coalesce(1)
    dealt = model.dealt(rows)
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in dealt.groupBy(F.input_file_name()).count().collect()]
    assert dealt.count() == 4000 and len(sizes) == many and max(sizes) < 2 * 4000 / many


def test_listed_and_unlisted_pairs_make_up_all_pairs(spark):
    from crossmarket.plans import pairing
    from crossmarket.sources import derived
    root, ids = "/root/testdata/sf0.01", ("kalshi_id", "polymarket_id")
    rows = pairing.blocked(spark, root)
    listed = derived.evaluations(spark, root).select(*ids)
    key = lambda df: sorted(map(tuple, df.select(*ids).collect()))
    given, rest = (key(f(*a, derived.AS_OF)) for f, a in ((staged_filter.filter_given, (listed, rows)),
                                                         (staged_filter.filter_unlisted, (rows, listed))))
    assert given and rest and not set(given) & set(rest)
    assert sorted(given + rest) == key(staged_filter.filter_pairs(rows, derived.AS_OF))


@pytest.mark.parametrize("edge", [20, 100_000])
def test_count_within_against_all_pairs(spark, edge):
    """Pairs are counted, not formed: ratios of exactly a tenth, missing times, keys of one side only, hot keys in slices."""
    chance = random.Random(edge)
    rows = [[(i, chance.choice(keys), chance.randrange(500, 9500, 50), chance.choice((None, 0, 40, 41, 400)),
              chance.choice((0.7, 7.0, 70.0, 70.1, 333.3, 33.33))) for i in range(n)] for n, keys in ((150, "abc"), (130, "bcd"))]
    sides = [spark.createDataFrame(r, "id int, key string, step int, time int, volume double") for r in rows]
    wanted = {"near": (200, 1000, None, 0.1), "timed": (200, 1000, 41, 0.1), "far": (1000, None, 40, 0.1)}
    got = box_counts.count_within(*sides, ["key"], wanted, edge).first()
    for name, (least, end, seconds, ratio) in wanted.items():
        assert got[name] == sum(
            a[1] == b[1] and least <= abs(a[2] - b[2]) and (end is None or abs(a[2] - b[2]) < end)
            and (seconds is None or None not in (a[3], b[3]) and abs(a[3] - b[3]) <= seconds)
            and min(a[4], b[4]) / max(a[4], b[4]) >= ratio for a in rows[0] for b in rows[1]), name


def test_run_log_derives_the_envelopes_once(spark, monkeypatch):
    """The six passes over the envelopes read a written table: nothing is joined or aggregated again for each."""
    from crossmarket.operators import normalize
    seen, dispatch = [], normalize.dispatch

    def watched(envelopes, *rest):
        seen.append(envelopes._jdf.queryExecution().optimizedPlan().toString())
        return dispatch(envelopes, *rest)

    monkeypatch.setattr(normalize, "dispatch", watched)
    entry.queries()["k28_run_log"](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 3 and not any("Join" in plan or "Aggregate" in plan for plan in seen)


def test_least_neighbours_without_hubs_take_one_shuffle(spark):
    """A long chain and a fan: no node has many edges, so no count of hubs, no second aggregate and no join."""
    edges = spark.range(20_000).select((F.col("id") + 1).alias("u"), "id").toDF("u", "v").unionByName(
        spark.range(40).select(F.lit(50_000).cast("bigint").alias("u"), (F.col("id") + 30_000).alias("v")))
    found = groups._with_least(edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert found.agg(F.count_if(F.col("m") == F.when(F.col("u") == 50_000, 30_000).otherwise(F.col("u") - 1))).first()[0] == 20_040


def test_rolling_volatility_deals_a_batch_before_windows(spark):
    """One file of events is not windowed by the one task that reads it, also where one market has all of them."""
    history = spark.range(0, 4000, 1, 1).select(
        F.lit("m").alias("market_id"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), F.lit(0.5).alias("price"),
        F.lit(1.0).alias("volume"))
    found = metrics.rolling_volatility(history)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RepartitionByExpression")
    assert found.count() == 4023 and found.agg(F.max("points"), F.max("volatility")).first() == (24, 0.0)


def test_improved_matches_derive_their_listings_once(spark, monkeypatch):
    """Neither the source nor the keywords of a title belong into the joins of listings, which are read many times."""
    chance, cuts = random.Random(8), []
    words = ("trump", "bitcoin price", "election day", "super bowl", "rain", "sun", "")
    rows = []
    for v in ("kalshi", "polymarket"):
        for i in range(60):
            title = " ".join(chance.choices(words, k=chance.randint(1, 4))).strip()
            rows.append((f"{v}{i}", v, title, chance.choice("AB"), chance.randint(500, 9500) / 10_000, 100.0 + i, 1.0, title,
                         title[:8] + str(i % 3), True))
    monkeypatch.setattr(candidates, "cut", lambda df: cuts.append(df.columns) or similarity_join.cut(df))
    got = candidates.improved_matches(spark.createDataFrame(rows, LISTING))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(cuts) == 2 and "LocalRelation" not in plan and "LogicalRDD" not in plan
    assert "arrays_overlap" not in plan and "array_intersect" not in plan

    def expected(k, p):
        a, b = k[7], p[7]
        inside = len(b) if b in a else len(a) if a in b else 0
        title = 1.0 if k[8] == p[8] else 1 - (len(a) + len(b) - 2 * inside) / max(len(a), len(b)) if min(len(a), len(b)) > 5 else 0.0
        shared = 0.3 if any(w in a and w in b for w in vocab.BONUS_KEYWORDS) else 0.0
        return title + (0.2 if k[3] == p[3] else 0.0) + shared

    want = {(k[0], p[0]) for k in rows for p in rows if k[1] == "kalshi" and p[1] == "polymarket"
            and round(abs(k[4] - p[4]), 6) > 0.03 and round(expected(k, p), 6) > 0.4}
    found = [(r.kalshi_id, r.polymarket_id) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 100


def test_similar_titles_are_compared_as_far_as_allowed_and_once(spark):
    chance = random.Random(9)
    texts = ["".join(chance.choices("abc", k=chance.randint(0, 12))) for _ in range(160)]
    left, right = (spark.createDataFrame([("A", t) for t in part], f"_category string, {name} string")
                   for part, name in ((texts[:80], "x"), (texts[80:], "y")))
    got = similarity_join.edit_similar_titles(left, right, ["_category"], ("x", "y"), 0.7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    calls = [c.split(")")[0] for c in plan.split("levenshtein(")[1:]]
    assert len(calls) == 1 and calls[0].count(",") == 2  # with a limit, and not again for the filter
    every = left.distinct().crossJoin(right.drop("_category").distinct()).where("x <> '' AND y <> ''").withColumn(
        "s", text.levenshtein_ratio(F.col("x"), F.col("y"))).where("s > 0.7")
    want = sorted(tuple(r) for r in every.select("x", "y", "s").collect())
    assert sorted((r.x, r.y, r.title_similarity) for r in got.collect()) == want and len(want) > 30
