"""The k best pairs by an additive score, forming little more than k pairs.

The score of a pair is the points of its class (same category, shared keyword), of its price gap and of its smaller volume.

1. Volume levels are cut where the pairs above grow by half, read off a fine histogram. Listings are counted per class
   key, price cell and volume level. From these histograms follows, for every level and gap, a lower bound of the
   pairs that reach it: prefix sums over levels and price cells, no pairs.
2. The highest (score, level) that at least k pairs are known to reach is the floor: everything below is beaten k times.
3. For each class and gap the floor says which level both listings need. Only those rows are joined. "At least so
   far apart in price" becomes an equality: one side is filed under the binary intervals around its price cell, the other
   looks up the intervals that tile the cells far enough away, so a pair too close in price never meets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.functions import vocab
from crossmarket.operators import scoring
from crossmarket.operators.intervals import apart, around, price_cell

OWN = ("_category", "_words", "_price", "_volume")
FINE = 4096  # bins of the volume histogram per decade


def volume_points(volume: float) -> int:
    return next((points for points, bound in scoring.VOLUME_POINTS if volume > bound), 0)


def volume_cuts(sides: tuple[DataFrame, DataFrame], growth: float = 1.5) -> list[float]:
    """Ascending volumes that part the levels: the bounds of the points, and one wherever the pairs above grew by `growth`.

    About a hundred, whatever the tables hold; the histogram on the driver has at most FINE bins per decade.
    """
    bins = F.floor(F.log10(F.greatest("_volume", F.lit(1.0))) * FINE).alias("bin")
    counts = None
    for side, mine in zip(sides, ((1, 0), (0, 1))):
        part = side.select(bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(
            "bin", *[(F.col("n") * on).alias(c) for c, on in zip("ab", mine)])
        counts = part if counts is None else counts.unionByName(part)
    cuts, above, last = {math.nextafter(bound, math.inf) for _, bound in scoring.VOLUME_POINTS}, [0, 0], 0
    for bin_, a, b in sorted(counts.groupBy("bin").agg(F.sum("a"), F.sum("b")).collect(), reverse=True):
        above = [above[0] + a, above[1] + b]
        if above[0] * above[1] > last * growth:
            cuts.add(10.0 ** (bin_ / FINE))
            last = above[0] * above[1]
    return sorted(cuts)


def volume_level(volume: Column, cuts: list[float]) -> Column:
    """How many cuts a volume reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= volume))


def reached_pairs(sides: tuple[DataFrame, DataFrame], words: tuple) -> list[tuple[int, int, int, float]]:
    """(class points, gap points, level, pairs): so many pairs at least have these points and volumes of this level.

    One number per class and level comes to the driver, whatever the tables hold.
    """
    bounds = [F.struct(F.lit("all").alias("bound"), F.lit("").alias("key"), F.lit(0).alias("points")),
              F.when(F.col("_category").isNotNull(), F.struct(
                  F.lit("category").alias("bound"), F.col("_category").alias("key"), F.lit(50).alias("points")))]
    sure = 10 ** 9
    for word, points in words:
        sure = min(sure, points)  # a pair that shares this word scores for it or for one before it
        for name, key, extra in (("word:", F.lit(""), 0), ("both:", F.col("_category"), 50)):
            bounds.append(F.when(F.array_contains("_words", word) & key.isNotNull(), F.struct(
                F.lit(name + word).alias("bound"), key.alias("key"), F.lit(sure + extra).alias("points"))))
    counted = None
    for side, mine, other in ((sides[0], "a", "b"), (sides[1], "b", "a")):
        rows = side.select("_cell", "_level", F.explode(F.array_compact(F.array(*bounds))).alias("g")).select("g.*", "_cell", "_level")
        part = rows.groupBy("bound", "key", "points", "_cell", "_level").agg(F.count(F.lit(1)).alias(mine)).withColumn(other, F.lit(0))
        counted = part if counted is None else counted.unionByName(part)
    levels = counted.select("_level").distinct()
    at = ["bound", "key", "points", "level"]
    present = sorted(r[0] for r in levels.collect())  # some dozens
    reach = (counted.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, present)), lambda x: x <= F.col("_level"))))
             .groupBy(*at, "_cell").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")))
    whole = Window.partitionBy(*at)
    for points, gap in scoring.GAP_POINTS:
        # Cells this far apart leave more than the gap between any two prices in them.
        near = whole.orderBy("_cell").rangeBetween(-round(gap * 100) - 1, round(gap * 100) + 1)
        reach = reach.withColumn(f"far{points}", F.sum("b").over(whole) - F.sum("b").over(near))
    reach = reach.withColumn("far0", F.sum("b").over(whole))
    tiers = [points for points, _ in scoring.GAP_POINTS] + [0]
    sums = reach.groupBy("bound", "points", "level").agg(*[F.sum(F.col("a") * F.col(f"far{t}")).alias(f"far{t}") for t in tiers])
    return [(r["points"], t, r["level"], r[f"far{t}"]) for r in sums.collect() for t in tiers]


def score_floor(reached: list[tuple[int, int, int, float]], cuts: list[float], k: int, minimum: int) -> tuple[int, int]:
    """The highest (score, level) that k pairs are sure to reach, or (minimum, 0) where there are fewer."""
    best = (minimum, 0)
    for points, gap, level, pairs in reached:
        score = points + gap + (volume_points(cuts[level - 1]) if level else 0)
        if pairs >= k and (score, level) > best:
            best = (score, level)
    return best


def needed_level(floor: tuple[int, int], cuts: list[float], points: int, gap: int) -> int | None:
    """The lowest volume level at which a pair with these points is not below the floor; None if there is none."""
    return next((level for level in range(len(cuts) + 1)
                 if (points + gap + (volume_points(cuts[level - 1]) if level else 0), level) >= floor), None)


def reachable_pairs(left: DataFrame, right: DataFrame, k: int, minimum: int, gap: Column) -> DataFrame:
    """All pairs that can be among the k best with at least `minimum` points, and not many others.

    Both sides need _category, _words (the listed keywords they hold), _price and _volume; `gap` is the pair's price gap over
    their other columns. Prices or volumes that are missing score nothing, so such rows must be left out before.
    """
    cuts = volume_cuts((left, right))
    sides = tuple(d.withColumn("_cell", price_cell(F.col("_price"))).withColumn("_level", volume_level(F.col("_volume"), cuts))
                  for d in (left, right))
    words = vocab.SCORE_KEYWORDS
    floor = score_floor(reached_pairs(sides, words), cuts, k, minimum)
    left_at, right_at = [], []  # where a row is filed or looked up: class of the pair, gap points, keyword, category, cells
    for in_category in (True, False):
        for word, worth in (*words, ("", 0)):
            for points, least in (*scoring.GAP_POINTS, (0, None)):
                need = needed_level(floor, cuts, 50 * in_category + worth, points)
                if need is None:
                    continue
                fits = F.col("_level") >= need
                fits = fits & F.array_contains("_words", word) if word else fits
                fits = fits & F.col("_category").isNotNull() if in_category else fits
                both = [F.lit(in_category).alias("_same"), F.lit(points).alias("_gap"), F.lit(word).alias("_word"),
                        (F.col("_category") if in_category else F.lit("")).alias("_key")]
                anywhere = F.array(F.lit(0))
                far = anywhere if least is None else apart(F.col("_cell"), round(least * 100) - 1)
                left_at.append(F.when(fits, F.struct(*both, far.alias("_cells"))))
                right_at.append(F.when(fits, F.struct(*both, (anywhere if least is None else around(F.col("_cell"))).alias("_cells"))))
    if not left_at:
        return left.drop(*OWN).join(right.drop(*OWN), F.lit(False))
    keys = ["_same", "_gap", "_word", "_key", "_at"]
    filed = []
    for side, places, mark in ((sides[0], left_at, "a"), (sides[1], right_at, "b")):
        rows = side.withColumn("_place", F.explode(F.array_compact(F.array(*places)))).select("*", "_place.*").withColumn(
            "_at", F.explode("_cells"))
        filed.append(rows.withColumnsRenamed({"_category": f"_c{mark}", "_words": f"_w{mark}"}).drop(
            "_place", "_cells", "_cell", "_level", "_price", "_volume"))
    first = F.coalesce(F.get(F.array_intersect("_wa", "_wb"), F.lit(0)), F.lit(""))
    same = F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))
    wanted = (same == F.col("_same")) & (first == F.col("_word")) & (scoring.gap_points(gap) == F.col("_gap"))
    return filed[0].join(filed[1], keys).where(wanted).drop(*keys, "_ca", "_cb", "_wa", "_wb")
