"""Match groups: connected components of similarity edges, and what hangs off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.sources.checkpoints import cut_at, release


def _split(edges: DataFrame, share: int = 1000) -> DataFrame:
    """The edges (u, v) with _part: 0, or for hubs of more than 1 / `share` of the edges a number from the leaf's hash.

    There are fewer than `share` such hubs, so their list is broadcast.
    """
    total = edges.count()
    hubs = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > total)
    parts = F.ceil(F.col("n") * share / F.lit(total)).cast("int")
    return edges.join(F.broadcast(hubs.select("u", parts.alias("_parts"))), "u", "left").withColumn(
        "_part", F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def _least_neighbours(split: DataFrame) -> DataFrame:
    """(u, _part, m): the smallest neighbour of u, for every part of its edges: first within parts, then over them."""
    within = split.groupBy("u", "_part").agg(F.min("v").alias("m"))
    return within.select("u", "_part").join(within.groupBy("u").agg(F.min("m").alias("m")), "u")


def _has_hubs(edges: DataFrame, share: int = 1000, few: int = 10_000) -> bool:
    """Whether a node has more than `few` edges and more than 1 / `share` of them; two numbers reach the driver."""
    most, total = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return most is not None and most > few and most * share > total


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges (u, v) with m, the smallest neighbour of u. Without hubs a window finds it in one shuffle of the edges."""
    if not _has_hubs(edges):
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    split = _split(edges)
    return split.join(_least_neighbours(split), ["u", "_part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of its neighbourhood."""
    both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    ends = F.explode(F.array("u", "v")).alias("u")
    return down.select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): component is the smallest node id it reaches.

    Alternating large-star and small-star steps; each is a min per node (combined before the
    shuffle) and an equi-join, and the number of rounds grows with the logarithm of the longest
    path. The edges of a hub are split by leaf, so no task gets them all. Every round is
    written out, so plans stay short and a lost executor costs one round.
    """
    stars, path = cut_at(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        last = path
        large, large_path = cut_at(_large_star(stars).distinct())
        stars, path = cut_at(_small_star(large))
        for done in (last, large_path):
            release(edges.sparkSession, done)
        # Two numbers per round reach the driver: the edge count and an order-free checksum.
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == seen:
            break
        before = seen
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def match_groups(similarities: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Group memberships from edges above a confidence: (market_id, group_id, confidence).

    A membership's confidence is the strongest of its own edges. Unlike edge-by-edge insertion,
    the result does not depend on the order of the edges.
    """
    strong = similarities.where(F.col("confidence_score") > threshold)
    parts = connected_components(strong, "kalshi_id", "polymarket_id")
    ends = strong.select(F.col("kalshi_id").alias("market_id"), "confidence_score").unionByName(
        strong.select(F.col("polymarket_id").alias("market_id"), "confidence_score"))
    own = ends.groupBy("market_id").agg(F.max("confidence_score").alias("confidence"))
    return own.join(parts.select(F.col("node").alias("market_id"), F.col("component").alias("group_id")), "market_id")


def group_table(memberships: DataFrame, markets: DataFrame) -> DataFrame:
    """One row per group: name, category and confidence of its most confident member."""
    listed = memberships.join(markets.select(F.col("id").alias("market_id"), "title", "category"), "market_id")
    best = F.struct(F.col("confidence"), F.col("market_id"))
    return listed.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"), F.max("confidence").alias("confidence"),
        F.concat(F.max_by("title", best), F.lit(" (Group)")).alias("name"),
        F.max_by("category", best).alias("category")).withColumn("is_verified", F.lit(False))


def latest_groups(memberships: DataFrame, markets: DataFrame, platforms: DataFrame,
                  limit: int = 50) -> DataFrame:
    """The last groups with one row per member, its title and platform.

    Flat rather than nested: a group may be large, and a row per member never has to fit in one
    place. Groups are cut to the limit first, then only their members are joined.
    """
    groups = group_table(memberships, markets).orderBy(F.desc("group_id")).limit(limit)
    members = (memberships.select("market_id", "group_id")
               .join(F.broadcast(groups.select("group_id", "name", F.col("confidence").alias("group_confidence"))), "group_id")
               .join(markets.select(F.col("id").alias("market_id"), "title", "platform"), "market_id"))
    names = platforms.select(F.col("name").alias("platform"), "display_name")
    return members.join(names, "platform", "left").withColumn("platform", F.coalesce("display_name", "platform")).drop(
        "display_name")


def unprocessed(markets: DataFrame, memberships: DataFrame) -> DataFrame:
    """Active markets that are in no group yet."""
    known = memberships.select(F.col("market_id").alias("id"))
    return markets.where(F.col("status") == "active").join(known, "id", "left_anti")


def memberships_of(memberships: DataFrame, selection: DataFrame) -> DataFrame:
    return memberships.join(selection.select(F.col("id").alias("market_id")), "market_id", "left_semi")


def platform_status(platforms: DataFrame, logs: DataFrame, recent: int = 100, keep: int = 5) -> DataFrame:
    """Last logs per platform among the most recent ones, and the last sync time."""
    latest = logs.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(recent)
    order = Window.partitionBy("platform").orderBy(F.desc("timestamp"), F.desc("log_id"))
    kept = latest.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    grouped = kept.groupBy("platform").agg(
        F.sort_array(F.collect_list(F.struct("rn", "log_id", "status"))).alias("recent_logs"),
        F.max("timestamp").alias("last_sync"))
    return platforms.join(grouped, platforms.name == grouped.platform, "left").drop("platform")
