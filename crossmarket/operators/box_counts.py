"""How many pairs of two tables lie within bounds of each other, without forming the pairs.

A row of the left table asks for the right rows of its key inside a box of price steps, times and volumes. Tasks sort the
right rows and cut each box into blocks of a power of two of rows (a range tree), so a row costs some lookups, however
many partners it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.operators.pairing import sliced_sides
from crossmarket.sources.workers import reachable

EDGE = 100_000
NEVER = np.iinfo(np.int64).min
BOUND = 1 << 60


def blocks(low: np.ndarray, high: np.ndarray):
    """Per level, (level, query numbers, block numbers): blocks of 2 ** level that together are low <= i < high."""
    ids, level = np.arange(len(low)), 0
    while True:
        live = low < high
        ids, low, high = ids[live], low[live], high[live]
        if not len(ids):
            return
        first, last = (low & 1).astype(bool), (high & 1).astype(bool)
        yield level, np.concatenate([ids[first], ids[last]]), np.concatenate([low[first], high[last] - 1])
        low, high, level = (low + first) >> 1, high >> 1, level + 1


def box_sums(points: dict, boxes: dict) -> np.ndarray:
    """Per box, the number of points of its cell with step, time and volume in [*_low, *_high]."""
    names, cell = np.unique(points["cell"], return_inverse=True)
    axes = {a: np.unique(points[a], return_inverse=True) for a in ("step", "time", "volume")}
    own = np.minimum(np.searchsorted(names, boxes["cell"]), len(names) - 1)
    reach = {a: (np.searchsorted(values, boxes[f"{a}_low"], "left"), np.searchsorted(values, boxes[f"{a}_high"], "right"))
             for a, (values, _) in axes.items()}
    low, high = reach["step"]
    high = np.where(names[own] == boxes["cell"], high, low)
    n, sums = len(cell), np.zeros(len(own), dtype=np.int64)
    (steps, step), (times, time), (volumes, volume) = (axes[a] for a in ("step", "time", "volume"))
    for level, ids, block in blocks(low, high):
        place = (cell * len(steps) + (step >> level)) * len(times) + time
        order = np.argsort(place, kind="stable")
        at, held = place[order], volume[order]
        start = (own[ids] * len(steps) + block) * len(times)
        for inner, js, part in blocks(*(np.searchsorted(at, start + reach["time"][i][ids]) for i in (0, 1))):
            run = np.sort((np.arange(n) >> inner) * len(volumes) + held)
            first, last = (np.searchsorted(run, part * len(volumes) + reach["volume"][i][ids[js]]) for i in (0, 1))
            np.add.at(sums, ids[js], last - first)
    return sums


def ratio_bounds(volume: np.ndarray, ratio: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest volume v with min / max >= ratio, as divisions of doubles decide it."""
    if ratio is None:
        return np.full(len(volume), -np.inf), np.full(len(volume), np.inf)
    low, high = volume * ratio, volume / ratio
    for _ in range(8):  # a few last digits at most
        low = np.where(low / volume >= ratio, np.nextafter(low, 0), low)
        high = np.where(volume / high >= ratio, np.nextafter(high, np.inf), high)
    for _ in range(16):
        low = np.where(low / volume >= ratio, low, np.nextafter(low, np.inf))
        high = np.where(volume / high >= ratio, high, np.nextafter(high, 0))
    return low, high


def count_within(left: DataFrame, right: DataFrame, keys: list[str], wanted: dict[str, tuple], edge: int = EDGE) -> DataFrame:
    """One row: for each name in `wanted`, the number of pairs with equal keys that it asks for.

    Both sides have the keys and id, step (whole price steps), time (seconds or null) and volume (positive). An entry is
    (least, end, seconds, ratio): pairs with least <= |step difference| < end (None: any) that are at most `seconds` apart
    in time and have a volume ratio of at least `ratio` (None: any).
    """
    reachable(left.sparkSession)
    bins = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = sliced_sides(left.withColumnRenamed("id", "_ida"), right.withColumnRenamed("id", "_idb"), keys, "_ida", "_idb",
                        edge * edge)

    def cells(df: DataFrame) -> DataFrame:
        cell = F.xxhash64(*keys, "_r", "_c")
        time: Column = F.coalesce(F.col("time"), F.lit(NEVER))
        return df.select(F.pmod(cell, F.lit(bins)).alias("_bin"), cell.alias("cell"), F.col("step").cast("bigint").alias("step"),
                         time.cast("bigint").alias("time"), F.col("volume").cast("double").alias("volume"))

    def counted(k: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if k.empty or p.empty:
            return pd.DataFrame({name: [] for name in wanted}, dtype="int64")
        points = {c: p[c].to_numpy() for c in ("cell", "step", "time", "volume")}
        cell, step, time, volume = (k[c].to_numpy() for c in ("cell", "step", "time", "volume"))
        asked = []
        for least, end, seconds, ratio in wanted.values():
            reach = BOUND if end is None else end - 1
            low, high = ratio_bounds(volume, ratio)
            # No time: no partner within any number of seconds.
            when = ((np.full(len(time), NEVER), np.full(len(time), BOUND)) if seconds is None else
                    (np.where(time == NEVER, BOUND, time - seconds), np.where(time == NEVER, BOUND, time + seconds)))
            for near, far in ((step + least, step + reach), (step - reach, step - max(least, 1))):
                asked.append({"cell": cell, "step_low": near, "step_high": far, "time_low": when[0], "time_high": when[1],
                              "volume_low": low, "volume_high": high})
        boxes = {c: np.concatenate([box[c] for box in asked]) for c in asked[0]}
        sums = box_sums(points, boxes).reshape(len(wanted), -1).sum(axis=1)
        return pd.DataFrame({name: [total] for name, total in zip(wanted, sums)})

    found = cells(a).groupBy("_bin").cogroup(cells(b).groupBy("_bin")).applyInPandas(
        counted, ", ".join(f"{name} bigint" for name in wanted))
    return found.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in wanted])
