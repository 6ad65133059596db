"""Every registered training-data query, whole, against SQL or a brute-force version on the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference, duck
from crossmarket.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(run(spark, name), duck(SF).execute(ORACLES[name]).df()) is None


def test_op1_finds_all_passages(spark, docs, benchmark):
    got = run(spark, "op1_cgk_decontamination")
    inside = {(d, b) for d, t in zip(docs.doc_id, docs.text) for b, p in zip(benchmark.item_id, benchmark.text) if p in t}
    assert set(zip(got.doc_id, got.item_id)) == inside


def test_op2_base_score_and_model(spark, docs):
    got = run(spark, "op2_class_ngrams").set_index("doc_id")
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in zip(docs.doc_id, docs.text)}
    counts = Counter(w for i, ws in tokens.items() if not held(i, 10) for w in ws)
    total = sum(counts.values())
    for i, ws in tokens.items():
        row = got.loc[i]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws)
        assert row.held_out == held(i, 10) and row.n_tokens == len(ws) and row.train_tokens == total
        assert row.n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
    apart = got[got.held_out]
    assert apart.score.sum() > apart.base_score.sum()  # classes tell more than word counts alone


def test_op3_held_out_accuracy(spark, docs):
    got = run(spark, "op3_kneser_ney_language").merge(docs[["doc_id", "lang"]], on="doc_id")
    apart = got[got.held_out]
    assert len(got) == len(docs) and (apart.lang == apart.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def shingles(text, size):
    words = WORD.findall(lower(text))
    width = min(size, len(words))
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1)) if width else frozenset()


def brute_components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    owners, parent = defaultdict(list), {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in owners[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and top(i) != top(j):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
        for s in sets[i]:
            owners[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_op4_brute_force(spark, docs):
    got = run(spark, "op4_minhash_near_dup")
    want = brute_components(dict(zip(docs.doc_id, docs.text)), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got.kept == (got.doc_id == got.component_id)).all()


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.span()))
    return found + [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                    if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def digest(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, (start, end) in spans)


def test_op5_base_spans(spark, docs):
    got = run(spark, "op5_anchored_pii").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        spans = base_spans(text)
        assert got.loc[i].base_sha256 == sha256(digest(spans).encode()).hexdigest()
        assert got.loc[i].n_card == sum(k == "card" for k, _ in spans)


def test_op6_library_counts(spark, docs):
    from crossmarket.llm.encoders import library
    got = run(spark, "op6_token_counts").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        n = len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False))
        assert (got.loc[i].n_tokens, got.loc[i].n_bytes, got.loc[i].over_limit) == (n, len(text.encode()), n > 1024)


def brute_pieces(texts):
    from crossmarket.llm.encoders import library
    pieces = []
    for i, text in texts.items():
        ids = np.array([*library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
                   for k, at in enumerate(range(0, len(ids), 4096))]
    return pieces


def check_packed(got, pieces):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(pieces)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()][:-1] and rows.length.sum() <= 4096
    free: list[int] = []
    for length in sorted((p[3] for p in pieces), reverse=True):  # best-fit decreasing, one by one
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(4096 - length)
    assert got.sequence_id.nunique() == len(free)


def test_op8_round_trip_and_brute_force(spark, docs):
    check_packed(run(spark, "op8_best_fit_packing"), brute_pieces(dict(zip(docs.doc_id, docs.text))))


def test_op9_held_out_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    got = QUERIES["op9_rule_ensemble"](spark, "/root/testdata/sf0.01").toPandas()
    apart = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (apart.predicted == apart.quality).mean() >= 0.9
    assert (got.predicted == (got.score >= 0.3)).all()


def test_pipeline_against_brute_force(spark, docs, benchmark):
    from crossmarket.llm.pii import redacted_text
    from crossmarket.llm.rule_ensemble import keep_quality
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = keep_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).toPandas()
    groups = brute_components(dict(zip(good.doc_id, good.text)), 5, 80)
    kept = {i: t for i, t in zip(good.doc_id, good.text) if groups[i][1] == i}
    clean = {i: t for i, t in kept.items() if not any(p in t for p in benchmark.text)}
    check_packed(corpus_pipeline.run(spark, SF).toPandas(), brute_pieces({i: redacted_text(t) for i, t in clean.items()}))
    assert len(clean) < len(kept) < len(good) < len(docs)
