"""Cross-venue pairs and the five-stage filter over them.

Stages: compatibility, text, liquidity, time window, net potential. The stage-3 ratio and the
stage-4 window are part of the join key (as cells), so pairs they rule out are never formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.config import FilterConfig
from crossmarket.functions import dates, prices, text, vocab
from crossmarket.operators.box_counts import count_within
from crossmarket.operators.pairing import once, slice_join, window_keys
from crossmarket.operators.similarity_join import jaccard_prefix, prefix_join
from crossmarket.sources.checkpoints import cut

STAGES = ("basic_compatibility", "text_similarity", "liquidity_filtering", "time_window_alignment",
          "arbitrage_potential")
PRICE_UNIT = 10_000  # normalized prices have four decimals


def eligible(markets: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Listings that can be in any pair: valid price, in range, enough volume."""
    price = F.col("yes_price")
    return markets.where(price.between(*cfg.valid_price) & (F.col("volume") >= cfg.min_volume)
                         & price.between(*cfg.price_range))


def side(markets: DataFrame, platform: str, keys: list[str],
         cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """One venue's eligible listings with everything a pair needs computed once per listing."""
    chosen = eligible(markets.where(F.col("platform") == platform), cfg)
    return chosen.select(
        *keys, F.col("id").alias(f"{platform}_id"), F.col("title").alias(f"{platform}_title"),
        F.col("category").alias(f"{platform}_category"), F.lower("category").alias(f"{platform}_kind"), F.col("yes_price").alias(f"{platform}_price"),
        F.col("volume").alias(f"{platform}_volume"), F.col("close_time").alias(f"{platform}_close_time"),
        F.unix_timestamp(F.col("close_time").cast("timestamp")).alias(f"{platform}_epoch"),
        text.tokens(F.col("title"), vocab.JACCARD_STOP_WORDS).alias(f"{platform}_tokens"),
        text.held_words(F.col("title"), vocab.JACCARD_STOP_WORDS).alias(f"{platform}_stops"),
        prices.liquidity_score(F.col("volume"), F.col("yes_price")).alias(f"{platform}_liquidity"))


def coded(kalshi: DataFrame, polymarket: DataFrame) -> list[DataFrame]:
    """Both sides with their tokens as a count, bits of the words that occur most, and an array of the others.

    A pair's shared words are then counted by bits. Any list of words gives the same counts; with the most frequent ones
    few arrays are left to compare, and rows stay narrow where they are repeated. Counts and times are doubles, as
    `text.shared_places` says. Listings without a close time are left out: no pair of theirs passes. What pairs compute with is
    never NULL, which shortens the code that runs for each of them (see METHOD_LIMIT in plans/registry.py).
    """
    sides = {"kalshi": kalshi, "polymarket": polymarket}
    words = reduce(DataFrame.unionByName, [df.select(F.explode(f"{v}_tokens").alias("word")) for v, df in sides.items()])
    most = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(64 * text.BIT_COLUMNS)
    listed = F.broadcast(most.agg(F.sort_array(F.collect_list("word")).alias("_listed")))  # one row
    found = []
    for v, df in sides.items():
        tokens = F.col(f"{v}_tokens")
        bits = {f"{v}_bits{i}": b for i, b in enumerate(text.place_bits(F.col("_at")))}
        rest = F.array_except(tokens, "_listed")
        timed = df.withColumn(f"{v}_epoch", F.col(f"{v}_epoch").cast("double")).where(F.col(f"{v}_epoch").isNotNull())
        placed = timed.crossJoin(listed).withColumn("_at", text.listed_places(tokens, F.col("_listed")))
        found.append(placed.withColumns({
            **bits, f"{v}_rest": F.when(F.array_contains("_at", -1), rest), f"{v}_words": F.size(tokens).cast("double"),
            f"{v}_liquidity": F.coalesce(f"{v}_liquidity", F.lit(0.0))}).drop("_listed", "_at", f"{v}_tokens"))
    return found


def with_shared_tokens(pairs: DataFrame) -> DataFrame:
    """Adds how many words the titles of a pair of `coded` sides share; arrays are compared once and after the join."""
    bits = [[F.col(f"{v}_bits{i}") for i in range(text.BIT_COLUMNS)] for v in ("kalshi", "polymarket")]
    compared = once(pairs, _shared_rest=text.shared_rest(F.col("kalshi_rest"), F.col("polymarket_rest")))
    return compared.withColumn("shared_tokens", text.shared_places(*bits) + F.col("_shared_rest")).drop("_shared_rest")


def overall_similarity(cfg: FilterConfig) -> Column:
    return text.jaccard(F.col("kalshi_tokens"), F.col("polymarket_tokens")) * cfg.title_weight


def passes_text(similarity: Column, gap: Column, cfg: FilterConfig) -> Column:
    """The cheap half first: where the gap is big the words are not compared."""
    return (gap >= cfg.big_gap) | (similarity >= cfg.min_similarity)


def compatible_pairs(kalshi: DataFrame, polymarket: DataFrame, keys: list[str],
                     cfg: FilterConfig = FilterConfig(), *, windows: bool = True,
                     condition: Column | None = None) -> DataFrame:
    """Pairs with equal keys and a sufficient price gap.

    With `windows` (the default) only pairs that can also pass the time and ratio stages are
    formed. Without them the result is the bare first stage, which is quadratic per key.
    """
    max_days, ratio = (cfg.max_days, cfg.min_volume_ratio) if windows else (None, None)
    k, cells = window_keys(kalshi, F.col("kalshi_epoch"), F.col("kalshi_volume"), max_days, ratio, False)
    p, _ = window_keys(polymarket, F.col("polymarket_epoch"), F.col("polymarket_volume"), max_days,
                       ratio, True)
    both = F.col("kalshi_price"), F.col("polymarket_price")
    wanted = prices.gap_reaches(*both, cfg.min_gap)
    if windows:
        apart = F.abs(F.col("kalshi_epoch") - F.col("polymarket_epoch"))
        wanted = (wanted & (apart <= cfg.max_days * 86400)
                  & (prices.volume_ratio(F.col("kalshi_volume"), F.col("polymarket_volume"))
                     >= cfg.min_volume_ratio))
    if condition is not None:
        wanted = wanted & condition
    pairs = slice_join(k, p, [*keys, *cells], "kalshi_id", "polymarket_id", wanted)
    return pairs.drop(*cells).withColumn("price_difference", prices.gap(*both))


def finish_stages(pairs: DataFrame, as_of: str, cfg: FilterConfig = FilterConfig(), *, measured: bool = True) -> DataFrame:
    """Text, liquidity, time and potential stages over compatible pairs of `coded` sides.

    Other than the text stage, every filter is plain arithmetic on columns of the listings, which the join evaluates before it
    forms a row. Without `measured` there is no text_similarity.
    """
    sizes, both = (F.col("kalshi_words"), F.col("polymarket_words")), (F.col("kalshi_price"), F.col("polymarket_price"))
    similarity = F.when((sizes[0] == 0) | (sizes[1] == 0), F.lit(0.0)).otherwise(
        F.col("shared_tokens") / (sizes[0] + sizes[1] - F.col("shared_tokens"))) * cfg.title_weight
    compared = with_shared_tokens(pairs)
    similar = compared.where(prices.gap_reaches(*both, cfg.big_gap) | (similarity >= cfg.min_similarity))
    if measured:
        similar = similar.withColumn("text_similarity", similarity)
    ratio = prices.volume_ratio(F.col("kalshi_volume"), F.col("polymarket_volume"))
    liquid = (similar.withColumn("liquidity_score",
                                 (F.col("kalshi_liquidity") + F.col("polymarket_liquidity")) / 2)
              .where((F.col("liquidity_score") >= cfg.min_liquidity_score)
                     & (ratio >= cfg.min_volume_ratio)))
    k_close, p_close = F.col("kalshi_epoch"), F.col("polymarket_epoch")
    soon = (dates.epoch_soon(k_close, as_of, cfg.closing_soon_hours)
            & dates.epoch_soon(p_close, as_of, cfg.closing_soon_hours))
    apart = F.abs(k_close - p_close)
    aligned = liquid.where(apart <= cfg.max_days * 86400).withColumn(
        "time_alignment_score", dates.alignment_score(apart, cfg.max_days, soon))
    return (aligned.where(prices.net_gap_reaches(*both, cfg.transaction_cost, cfg.min_gap))
            .withColumn("arbitrage_potential", prices.net_gap(F.col("price_difference"), cfg.transaction_cost)))


def filter_pairs(bucketed: DataFrame, as_of: str, cfg: FilterConfig = FilterConfig(),
                 keys: list[str] | None = None, *, measured: bool = True) -> DataFrame:
    """All five stages over listings that carry the blocking keys (default: bucket)."""
    keys = keys or ["bucket"]
    pairs = compatible_pairs(*coded(*(side(bucketed, v, keys, cfg) for v in ("kalshi", "polymarket"))), keys, cfg)
    return finish_stages(pairs, as_of, cfg, measured=measured)


def filter_given(pairs: DataFrame, bucketed: DataFrame, as_of: str, cfg: FilterConfig = FilterConfig(),
                 keys: list[str] | None = None) -> DataFrame:
    """The rows of `pairs` (kalshi_id, polymarket_id, ...) that `filter_pairs` keeps, with their columns and its own.

    Looks up both listings of each given pair, so the work grows with the given pairs and not with all that could be formed.
    """
    keys = keys or ["bucket"]
    k, p = coded(*(side(bucketed, v, keys, cfg) for v in ("kalshi", "polymarket")))
    joined = pairs.join(k, "kalshi_id").join(p, ["polymarket_id", *keys])
    gap = prices.gap(F.col("kalshi_price"), F.col("polymarket_price"))
    return finish_stages(joined.withColumn("price_difference", gap).where(F.col("price_difference") >= cfg.min_gap), as_of, cfg)


def filter_unlisted(bucketed: DataFrame, listed: DataFrame, as_of: str, cfg: FilterConfig = FilterConfig(),
                    keys: list[str] | None = None) -> DataFrame:
    """The pairs that `filter_pairs` keeps and that are not in `listed` (kalshi_id, polymarket_id).

    Every first listing brings the ids it is listed with into the pair join, so the pairs, which are many, are not
    shuffled to be held against the list. With `filter_given` of the list it makes up `filter_pairs`.
    """
    keys = keys or ["bucket"]
    known = listed.groupBy("kalshi_id").agg(F.collect_set("polymarket_id").alias("_known"))
    k, p = coded(*(side(bucketed, v, keys, cfg) for v in ("kalshi", "polymarket")))
    unlisted = ~F.coalesce(F.array_contains("_known", F.col("polymarket_id")), F.lit(False))
    pairs = compatible_pairs(k.join(known, "kalshi_id", "left"), p, keys, cfg, condition=unlisted)
    return finish_stages(pairs.drop("_known"), as_of, cfg)


def incremental_pairs(bucketed: DataFrame, as_of: str, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Pairs with at least one new listing: new x all, then old x new (never old x old).

    Only buckets that received something are touched (left semi); needs an is_new column.
    """
    touched = bucketed.where("is_new").select("bucket").distinct()
    live = bucketed.join(touched, "bucket", "left_semi")
    k, p = coded(*(side(live, v, ["bucket", "is_new"], cfg) for v in ("kalshi", "polymarket")))
    every = lambda df: df.drop("is_new")
    fresh = lambda df: df.where("is_new").drop("is_new")
    known = lambda df: df.where("NOT is_new").drop("is_new")
    parts = [compatible_pairs(fresh(k), every(p), ["bucket"], cfg),
             compatible_pairs(known(k), fresh(p), ["bucket"], cfg)]
    return finish_stages(parts[0].unionByName(parts[1]), as_of, cfg, measured=False)


def mapped_pairs(markets: DataFrame, mapping: DataFrame, as_of: str,
                 cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Pairs whose categories appear together in a mapping (kalshi_category, polymarket_category).

    The mapping bridges the two sides as an equi-join: it turns the venue-1 category into every
    allowed venue-2 category before the pair join.
    """
    k, p = coded(*(side(markets, v, [], cfg) for v in ("kalshi", "polymarket")))
    k = k.join(mapping, "kalshi_category").withColumnRenamed("polymarket_category", "_shard")
    p = p.withColumn("_shard", F.col("polymarket_category"))
    return finish_stages(compatible_pairs(k, p, ["_shard"], cfg).drop("_shard"), as_of, cfg, measured=False)


def _first_stage_side(bucketed: DataFrame, platform: str, cfg: FilterConfig) -> DataFrame:
    price = F.col("yes_price")
    reason = (F.when(~price.between(*cfg.valid_price), "invalid_price")
              .when(F.col("volume") < cfg.min_volume, "low_volume")
              .when(~price.between(*cfg.price_range), "price_range").otherwise("ok"))
    counted = bucketed.where(F.col("platform") == platform).groupBy("bucket").agg(
        *[F.count_if(reason == r).alias(f"{platform}_{r}")
          for r in ("invalid_price", "low_volume", "price_range", "ok")])
    return counted


def pairs_within(bucketed: DataFrame, cfg: FilterConfig, gap: float) -> DataFrame:
    """Per bucket, the number of eligible pairs closer in price than `gap`, without forming them.

    Listings are first counted per price step; a range window over the steps (at most 10,000 per
    bucket and venue) then sums the partners in reach.
    """
    step = F.round(F.col("yes_price") * PRICE_UNIT).cast("bigint")
    steps = eligible(bucketed, cfg).groupBy("bucket", step.alias("step")).agg(
        F.count_if(F.col("platform") == "kalshi").alias("k"),
        F.count_if(F.col("platform") == "polymarket").alias("p"))
    reach = round(gap * PRICE_UNIT) - 1
    near = Window.partitionBy("bucket").orderBy("step").rangeBetween(-reach, reach)
    return (steps.withColumn("partners", F.sum("p").over(near)).groupBy("bucket")
            .agg(F.sum(F.col("k") * F.col("partners")).alias("pairs")))


def _similar_sets(k: DataFrame, p: DataFrame, cfg: FilterConfig) -> DataFrame:
    """(bucket, sk, sp): pairs of token sets of a bucket that are similar enough; copies of a set are compared once."""
    sides = []
    for df, tag in ((k, "k"), (p, "p")):
        sets = df.select("bucket", F.col("tokens").alias(f"s{tag}")).distinct()
        sides.append(sets.withColumn(f"i{tag}", F.xxhash64("bucket", f"s{tag}")))
    alike = text.jaccard(F.col("sk"), F.col("sp")) * cfg.title_weight >= cfg.min_similarity
    return prefix_join(sides[0], sides[1], ["bucket"], ("ik", "ip"), ("sk", "sp"),
                       jaccard_prefix(cfg.min_similarity / cfg.title_weight), alike).select("ik", "ip")


def stage_reasons(bucketed: DataFrame, as_of: str, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """How many pairs each stage drops for which first reason: (stage, reason, pairs).

    The first stage is counted from per-bucket totals and price histograms, the later ones by range counts over the
    listings of a bucket (wide gaps) and of similar token sets (the rest). Only pairs of low liquidity are formed.
    """
    k, p = (_first_stage_side(bucketed, v, cfg) for v in ("kalshi", "polymarket"))
    names = [f"{v}_{r}" for v in ("kalshi", "polymarket")
             for r in ("invalid_price", "low_volume", "price_range", "ok")]
    both = k.join(p, "bucket").select("bucket", *[F.col(n).cast("bigint").alias(n) for n in names])
    col = F.col
    k_valid = col("kalshi_price_range") + col("kalshi_ok")
    p_all = (col("polymarket_invalid_price") + col("polymarket_low_volume")
             + col("polymarket_price_range") + col("polymarket_ok"))
    first = both.join(pairs_within(bucketed, cfg, cfg.min_gap), "bucket", "left").join(
        pairs_within(bucketed, cfg, cfg.big_gap).withColumnRenamed("pairs", "below_big"), "bucket", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = first.agg(
        zero(col("kalshi_invalid_price") * p_all).alias("kalshi_invalid_price"),
        zero(col("kalshi_low_volume") * p_all).alias("kalshi_low_volume"),
        zero(k_valid * col("polymarket_invalid_price")).alias("polymarket_invalid_price"),
        zero(k_valid * col("polymarket_low_volume")).alias("polymarket_low_volume"),
        zero(col("kalshi_price_range") * (col("polymarket_price_range") + col("polymarket_ok")))
        .alias("kalshi_price_range"),
        zero(col("kalshi_ok") * col("polymarket_price_range")).alias("polymarket_price_range"),
        zero(F.coalesce(col("pairs"), F.lit(0))).alias("insufficient_gap"),
        zero(col("kalshi_ok") * col("polymarket_ok") - F.coalesce(col("pairs"), F.lit(0))).alias("stage1"),
        zero(F.coalesce(col("below_big"), F.lit(0)) - F.coalesce(col("pairs"), F.lit(0))).alias("small_gap"))
    row = totals
    for extra in _late_stage_counts(bucketed, cfg):  # one-row aggregates side by side
        row = row.withColumn("_j", F.lit(1)).join(extra.withColumn("_j", F.lit(1)), "_j").drop("_j")
    stage2_drop = col("small_gap") - col("similar")
    stage2 = col("stage1") - stage2_drop
    reasons = [
        (0, "kalshi_invalid_price", col("kalshi_invalid_price")),
        (0, "kalshi_low_volume", col("kalshi_low_volume")),
        (0, "polymarket_invalid_price", col("polymarket_invalid_price")),
        (0, "polymarket_low_volume", col("polymarket_low_volume")),
        (0, "kalshi_price_range", col("kalshi_price_range")),
        (0, "polymarket_price_range", col("polymarket_price_range")),
        (0, "insufficient_arbitrage", col("insufficient_gap")),
        (1, "low_text_similarity", stage2_drop),
        (2, "low_liquidity", col("low_liquidity")),
        (2, "volume_imbalance", stage2 - col("low_liquidity") - col("stage3")),
        (3, "time_misalignment", col("stage3") - col("stage4")),
        (4, "insufficient_arbitrage", col("stage4") - col("stage5")),
        (4, "passed", col("stage5"))]
    table = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(STAGES[i]).alias("stage"), F.lit(r).alias("reason"),
                 n.cast("bigint").alias("pairs")) for i, r, n in reasons]))
    return row.select(table.alias("t")).select("t.*")


def _late_stage_counts(bucketed: DataFrame, cfg: FilterConfig) -> list[DataFrame]:
    """One-row tables: similar pairs of small gap, survivors of stages three to five, and pairs of low liquidity."""
    k, p = (side(bucketed, v, ["bucket"], cfg) for v in ("kalshi", "polymarket"))
    wide, similar = _counted_stages(k, p, cfg)
    low = _low_liquidity_counts(k, p, cfg)
    both = wide.withColumn("_j", F.lit(1)).join(similar.withColumn("_j", F.lit(1)), "_j").join(low.withColumn("_j", F.lit(1)), "_j")
    total = lambda n: (F.col(f"wide{n}") + F.col(f"similar{n}") - F.col(f"low{n}")).alias(f"stage{n}")
    return [both.select("similar", *[total(n) for n in (3, 4, 5)], "low_liquidity")]


def _counted_stages(k: DataFrame, p: DataFrame, cfg: FilterConfig) -> tuple[DataFrame, DataFrame]:
    """Pairs in reach of stages three to five whatever their liquidity: of wide gaps (wide3 to wide5), and of similar
    titles and smaller gaps (similar3 to similar5, and `similar` before the ratio)."""
    steps = lambda gap: round(gap * PRICE_UNIT)
    small, big, net = steps(cfg.min_gap), steps(cfg.big_gap), steps(cfg.min_gap + cfg.transaction_cost)
    seconds, ratio = cfg.max_days * 86400, cfg.min_volume_ratio
    rows = []
    for df, v in ((k, "kalshi"), (p, "polymarket")):
        rows.append(cut(df.select(
            "bucket", F.col(f"{v}_id").alias("id"), F.round(F.col(f"{v}_price") * PRICE_UNIT).cast("bigint").alias("step"),
            F.col(f"{v}_epoch").alias("time"), F.col(f"{v}_volume").alias("volume"),
            F.sort_array(f"{v}_tokens").alias("tokens"))))
    wide = count_within(*(df.drop("tokens") for df in rows), ["bucket"], {
        "wide3": (big, None, None, ratio), "wide4": (big, None, seconds, ratio), "wide5": (max(big, net), None, seconds, ratio)})
    sets = _similar_sets(*rows, cfg)
    by_set = [df.withColumn(f"i{t}", F.xxhash64("bucket", "tokens")).drop("bucket", "tokens") for df, t in zip(rows, "kp")]
    similar = count_within(by_set[0].join(sets, "ik").drop("ik"), by_set[1], ["ip"], {
        "similar": (small, big, None, None), "similar3": (small, big, None, ratio), "similar4": (small, big, seconds, ratio),
        "similar5": (max(small, net), big, seconds, ratio)})
    return wide, similar


def _low_liquidity_counts(k: DataFrame, p: DataFrame, cfg: FilterConfig) -> DataFrame:
    """One row: stage-two pairs of low mean liquidity, and how many of them are in reach of stages three to five."""
    gap = prices.gap(F.col("kalshi_price"), F.col("polymarket_price"))
    stage2 = (gap >= cfg.min_gap) & passes_text(overall_similarity(cfg), gap, cfg)
    mean = (F.col("kalshi_liquidity") + F.col("polymarket_liquidity")) / 2
    # A low mean needs a low side, so only low-scoring listings are paired here.
    k_low, p_low = F.col("kalshi_liquidity"), F.col("polymarket_liquidity")
    limit = cfg.min_liquidity_score
    wanted = (mean < limit) & stage2
    low = slice_join(k.where(k_low < limit), p, ["bucket"], "kalshi_id", "polymarket_id", wanted).unionByName(
        slice_join(k.where(k_low >= limit), p.where(p_low < limit), ["bucket"], "kalshi_id", "polymarket_id", wanted))
    even = prices.volume_ratio(F.col("kalshi_volume"), F.col("polymarket_volume")) >= cfg.min_volume_ratio
    in_time = even & (F.abs(F.col("kalshi_epoch") - F.col("polymarket_epoch")) <= cfg.max_days * 86400)
    net = prices.net_gap(gap, cfg.transaction_cost) >= cfg.min_gap
    return low.agg(F.count(F.lit(1)).alias("low_liquidity"), F.count_if(even).alias("low3"),
                   F.count_if(in_time).alias("low4"), F.count_if(in_time & net).alias("low5"))


def funnel_summary(reasons: DataFrame, seconds: dict[str, float] | None = None) -> DataFrame:
    """Per stage: input, output, filter rate, share of the overall reduction.

    With measured stage seconds, stages above a fifth of the total time are marked bottlenecks.
    """
    dropped = reasons.where(F.col("reason") != "passed").groupBy("step", "stage").agg(
        F.sum("pairs").alias("filtered_count"))
    passed = reasons.where(F.col("reason") == "passed").agg(F.sum("pairs").alias("_passed"))
    # Five rows, so one ordered window over all of them is fine.
    later = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = (dropped.withColumn("_j", F.lit(1)).join(passed.withColumn("_j", F.lit(1)), "_j")
             .withColumn("input_count", F.sum("filtered_count").over(later) + F.col("_passed"))
             .withColumn("output_count", F.col("input_count") - F.col("filtered_count")))
    whole = Window.partitionBy()
    result = table.select(
        "step", "stage", "input_count", "output_count", "filtered_count",
        F.coalesce(F.try_divide("filtered_count", "input_count"), F.lit(0.0)).alias("filter_rate"),
        (1 - F.try_divide("_passed", F.max("input_count").over(whole))).alias("overall_reduction"))
    if seconds:
        total = sum(seconds.values())
        slow = [s for s, v in seconds.items() if v > 0.2 * total]
        result = result.withColumn("is_bottleneck", F.col("stage").isin(slow))
    return result


def best_per_bucket(scored: DataFrame, score: str, minimum: float = 0.3, keep: int = 50) -> DataFrame:
    """Top pairs of each bucket above a score."""
    order = Window.partitionBy("bucket").orderBy(F.col(score).desc(), "kalshi_id", "polymarket_id")
    return (scored.where(F.col(score) > minimum).withColumn("bucket_rank", F.row_number().over(order))
            .where(F.col("bucket_rank") <= keep))
