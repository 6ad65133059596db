"""Collocations: the double array against a dictionary, whole results against brute force, edge rows."""

import re
from collections import Counter

import numpy as np
import pytest

from crossmarket.llm.collocations import Trie, collocations

SCHEMA = "doc_id bigint, text string, lang string, n bigint, a bigint, rank string, phrase string, word string, number string"


@pytest.mark.parametrize("n,words,numbers,digits", [(1, 2, 3, 1), (3000, 2, 60, 1), (5000, 3, 900, 2), (20_000, 2, 300_000, 4)])
def test_trie_finds_exactly_its_phrases(n, words, numbers, digits):
    chance = np.random.default_rng(n)
    skewed = (numbers * chance.random((n, words)) ** 3).astype(np.int64)
    phrases = np.unique(skewed, axis=0)
    trie = Trie(phrases, digits)
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    text = np.concatenate([phrases[chance.integers(0, len(phrases), 2000)].ravel(), chance.integers(-1, numbers, 5000)]).astype(np.int32)
    at, which = trie.matches(text)
    want = {i: known[key] for i in range(len(text)) if (key := tuple(text[i:i + words].tolist())) in known}
    assert dict(zip(at.tolist(), which.tolist())) == want


def brute(rows, least, most=5, top=2000, percent=100):
    counts, totals, out = {}, Counter(), []
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            words = [w for w in re.split(r"[\x20\x09]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in piece)) if w]
            totals[lang or "und"] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i:i + size])] += 1
    for lang, f in counts.items():
        taken = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in taken.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longest[sub] = max(longest[sub], a)
        n, scored = totals[lang], []
        for p, a in taken.items():
            if longest[p] and 100 * longest[p] >= percent * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    chance = np.random.default_rng(5)
    names = np.array(["New", "york", "the", "of", "Été", "a\x01", "a", "x-1", "city", "état", "ß", "İ", "der"])
    share = np.arange(len(names), 0, -1.0) ** 2
    made = []
    for i in range(300):
        words = names[chance.choice(len(names), chance.integers(1, 60), p=share / share.sum())]
        glue = chance.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b"], len(words), p=[.7, .05, .05, .1, .05, .04, .01])
        made.append((i, "".join(w + g for w, g in zip(words, glue)), ["en", "fr", None, "en"][i % 4]))
    made += [(i, "the end of the line the end of the line", "en") for i in range(40)]  # a hot passage
    made += [(1, None, "en"), (2, "", None), (3, " \t\n..", "en"), (None, "New york", "en"), (4, "the " * 5000, "long")]
    return made


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("least,sizes", [(10, {}), (6, {"part_size": 60, "block_words": 50, "words_size": 9})])
def test_against_brute_force(table, rows, least, sizes):
    got = result(collocations(table, least, **sizes))
    assert got == brute(rows, least) and len(got) > 30


def test_parameters(table, rows):
    assert result(collocations(table, 5, most_words=3, inside_percent=60, top=4)) == brute(rows, 5, 3, 4, 60)


def test_empty_tables(table):
    assert collocations(table.limit(0)).count() == 0
    assert collocations(table.where("text IS NULL"), 1).count() == 0
    assert collocations(table, 10 ** 6).count() == 0


def test_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """A task that reads much text must not hold all its blocks at once: 60 blocks of one task are many row groups."""
    import random

    import pyarrow.parquet as pq

    from crossmarket.llm import collocations
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 1 << 14, raising=False)
    seen, written = [], collocations.Scratch.write

    def write(self, df, *bounds):
        table, path = written(self, df, *bounds)
        if "ids" in df.columns and "phrase" not in df.columns:
            seen.append([pq.ParquetFile(f) for f in sorted(__import__("glob").glob(f"{path}/*.parquet"))])
        return table, path

    monkeypatch.setattr(collocations.Scratch, "write", write)
    chance = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, "en", " ".join(chance.choices(words, k=2000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    collocations.phrase_counts(docs, 5, 2, block_words=2000)
    assert len(seen) == 2
    for files in seen:
        assert sum(f.metadata.num_rows for f in files) == 60
        assert all(f.metadata.row_group(g).num_rows <= 10 for f in files for g in range(f.metadata.num_row_groups))
