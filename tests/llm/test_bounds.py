"""What a worker holds: batches bounded by bytes, tables of one operator at a time; and the gram slots of op1."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from crossmarket.llm import class_lm, common, decontamination
from crossmarket.llm.decontamination import Scanner, build_index, gram_codes


def test_gram_slots_tell_what_a_search_tells():
    chance = random.Random(4)
    words = ["".join(chance.choice("abcdefgh") for _ in range(chance.randint(2, 6))) for _ in range(3000)]
    index = build_index([(i, " ".join(chance.choice(words) for _ in range(40))) for i in range(150)], 0.2)
    assert index.crowded.any()
    text = " ".join([*(chance.choice(words) for _ in range(5000)), index.texts[3].decode(), "zzzzzz"]).encode()
    codes = gram_codes(text)
    at, gram = Scanner(index)._known_grams(codes)
    want = np.flatnonzero(np.isin(codes, index.grams))
    assert at.tolist() == want.tolist() and (index.grams[gram] == codes[want]).all() and len(at) > 1000


def test_a_worker_keeps_the_tables_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    gone = []
    common.keeps("a", lambda: gone.append("a"))
    common.keeps("a", lambda: gone.append("a"))
    assert gone == []
    common.keeps("b")
    assert gone == ["a"] and list(common._kept) == ["b"]


def test_stages_take_batches_of_bounded_bytes(spark):
    before = spark.conf.get(common.ARROW_BYTES, None)
    docs = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 800) AS text")
    try:
        corpus_pipeline.personal_data(spark, docs, "")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

        assert docs.mapInArrow(sizes, "bytes bigint").agg({"bytes": "max"}).first()[0] < 6_000_000
    finally:
        if before is None:
            spark.conf.unset(common.ARROW_BYTES)


def test_the_edit_distance_leaves_a_text_that_cannot_reach_the_limit():
    class Counted(bytes):
        read = 0

        def __iter__(self):
            for c in bytes(self):
                Counted.read += 1
                yield c

    def places(pattern):
        return {c: sum(1 << i for i, x in enumerate(pattern) if x == c) for c in pattern}

    pattern = b"the quick brown fox jumps over the lazy dog"
    far = Counted(b"0123456789" * 8)
    assert decontamination.best_edit_distance(pattern, places(pattern), far, 8) > 8
    assert Counted.read < 0.7 * len(far)
    chance = np.random.default_rng(3)
    for _ in range(300):
        pattern, text = (bytes(chance.integers(97, 100, n).astype(np.uint8)) for n in (chance.integers(1, 14), chance.integers(0, 40)))
        whole = decontamination.best_edit_distance(pattern, places(pattern), text)
        for limit in range(len(pattern)):
            found = decontamination.best_edit_distance(pattern, places(pattern), text, limit)
            assert found == whole if whole <= limit else found > limit


def test_a_short_item_makes_no_candidates_of_long_ones(monkeypatch):
    """Bands are told apart by the least number of their own item, not by the least of all items."""
    chance, seen = np.random.default_rng(4), []
    letters = lambda n: bytes(chance.integers(97, 105, n).astype(np.uint8)).decode()
    items = [(0, "a short item of thirty letters")] + [(i, letters(300)) for i in range(1, 20)]
    union = np.union1d
    monkeypatch.setattr(decontamination.np, "union1d", lambda a, b: seen.append(len(a)) or union(a, b))
    text = items[5][1][:8].join(letters(50) for _ in range(40)) + items[7][1]
    found = decontamination.Scanner(decontamination.build_index(items, 0.2)).scan([text])
    assert found == {(0, 7): 0} and max(seen) < 20


def test_context_cells_hold_any_count_in_four_bytes():
    chance = np.random.default_rng(6)
    rows, slots = np.repeat(np.arange(50), 20), chance.integers(0, 1 << 16, 1000)
    n = chance.integers(1, 300_000, 1000)
    of, cells = class_lm._packed(rows, slots, n)
    column = pa.array([b"left out", *(cells[of == r].tobytes() for r in range(50)), b""], pa.binary()).slice(1)
    at, slot, many = class_lm._pairs(column)
    sums = lambda *x: {k: sum(v for a, b, v in zip(*map(np.ndarray.tolist, x)) if (a, b) == k)
                       for k in zip(x[0].tolist(), x[1].tolist())}
    assert sums(at, slot, many) == sums(rows, slots, n) and many.max() == class_lm.MOST
    few, small = class_lm._packed(rows, slots, np.minimum(n, 9))
    assert small.nbytes == 4000 and few is rows


def test_counts_of_parts_are_merged():
    chance = np.random.default_rng(7)
    for top in (40, 1 << 40, 1 << 62):
        parts = [np.unique(chance.integers(0, 30, 200) * (top // 30), return_counts=True) for _ in range(5)]
        keys, n = class_lm._merged([(k, c * 1000) for k, c in parts])
        want = np.unique(np.concatenate([np.repeat(k, c) for k, c in parts]), return_counts=True)
        assert (keys == want[0]).all() and (n == want[1] * 1000).all()
    assert [len(x) for x in class_lm._merged([])] == [0, 0]
