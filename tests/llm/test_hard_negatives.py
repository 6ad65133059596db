"""Hard negatives: the recursion against plain products, whole results against brute force, edge rows."""

import math

import numpy as np
import pytest

from crossmarket.llm.hard_negatives import Heaps, hard_negatives, strassen

SCHEMA = "vec_id bigint, embedding array<float>, label int, slot bigint, score double, number bigint, id string"


@pytest.mark.parametrize("m,n,k", [(1, 1, 1), (33, 70, 64), (129, 257, 65), (40, 41, 130)])
def test_strassen_is_exact(m, n, k):
    chance = np.random.default_rng(m)
    a, b = (chance.integers(-2 ** 27, 2 ** 27, (rows, k)) for rows in (m, n))
    assert (strassen(a, b, leaf=8) == a @ b.T).all()


def test_heaps_merge_ties_by_id():
    heaps = Heaps(2, 3)
    scores = np.array([[5, 5, 5, 5, 1], [1, 2, 3, 4, 5]])
    heaps.offer(np.array([0, 1]), scores, scores > 1, np.array([9, 8, 7, 6, 5]))
    heaps.offer(np.array([0, 1]), scores, scores > 1, np.array([19, 18, 2, 16, 15]))
    assert heaps.group.tolist() == [0, 0, 0, 1, 1, 1] and heaps.score.tolist() == [5, 5, 5, 5, 5, 4]
    assert heaps.ids.tolist() == [2, 6, 7, 5, 15, 6]


def brute(rows, every=10, k=5, low=80, high=100):
    taken = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
             if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, va, la) in enumerate(taken):
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, label == la)
                         for j, (i, v, label) in enumerate(taken) if j != at))
        for p, positive, _ in [s for s in scored if s[2]][:k]:
            near = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(a, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                              "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    chance = np.random.default_rng(1)
    centres = chance.normal(size=(4, 6))
    made = [(i, [float(np.float32(x)) for x in centres[i % 4] * 0.5 + chance.normal(size=6) * 0.6], i % 3)
            for i in range(400)]
    made += [(i, list(made[7][1]), i % 2) for i in range(400, 520)]  # a large group of equal vectors
    made += [made[20], made[20], made[30], (530, None, 1), (540, [1.0, None, 0.5], 1), (None, [1.0] * 6, 1),
             (550, [1.0] * 6, None), (560, [math.nan] * 6, 1), (570, [math.inf] * 6, 0), (580, [], 1), (590, [0.5, 0.25], 2)]
    return made


@pytest.mark.parametrize("block_bytes", [4 << 20, 700])
def test_against_brute_force(spark, rows, block_bytes):
    df = spark.createDataFrame([(i, v, label, 1, 0.5, 1, "x") for i, v, label in rows], SCHEMA)
    got = result(hard_negatives(df, "vec_id % 10 = 0", block_bytes=block_bytes, rows_per_tile=50))
    assert got == brute(rows) and len(got) > 500


def test_empty_tables(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1, 0.5, 1, "x") for i, v, label in rows], SCHEMA)
    assert hard_negatives(df.limit(0), "vec_id = 0").count() == 0
    assert hard_negatives(df, "vec_id = -1").count() == 0
    assert hard_negatives(df, "CAST(NULL AS boolean)").count() == 0


def test_text_ids_and_one_class(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.9, 0.0], "x"), ("é", [0.8, 0.0], "y"), ("c", [0.8, 0.0], "y")],
                               "vec_id string, embedding array<double>, label string")
    assert result(hard_negatives(df, "vec_id = 'a'")) == [("a", "b", 1, "c", 58880, 52224), ("a", "b", 2, "é", 58880, 52224)]
    assert hard_negatives(df.where("label = 'x'"), "vec_id = 'a'").count() == 0
