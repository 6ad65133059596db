"""Language identification by interpolated Kneser-Ney character models, one per language.

The models read the letters of a word with a boundary before and after it, so a text's cross-entropy is a
sum over its words and each distinct word is scored once per worker. All n-grams of all languages
stand in one sorted array of hashes per order, with the smoothed log-probability of each language beside
it (for an n-gram that a language has not seen, what its lower orders give); a lookup is a binary
search. The language with the lowest cross-entropy per letter is predicted. `score` is its share under
a temperature fitted on training words; `accepted` tells whether the cross-entropy lies below what
nearly all training texts of that language have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmarket.llm.common import held_out, id_type, keyed, reachable
from crossmarket.llm.encoders import slices

ORDER = 4
EDGE = 1  # the code before and after a word; letters are their code points
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_letters(text: str) -> list[str]:
    """Lower-case words of a text; what is not a letter is white space."""
    if text.isascii():
        return text.lower().translate(_ASCII_LETTERS).split()
    return text.lower().translate(_letters).split()


class _Letters(dict):
    def __missing__(self, code: int) -> str:
        self[code] = value = chr(code) if chr(code).isalpha() else " "
        return value


_letters = _Letters()
_ASCII_LETTERS = {c: (chr(c) if chr(c).isalpha() else " ") for c in range(128)}


def _grams(words: list[str]):
    """For every predicted character of every word: hashes of the n-grams of each order that end in it, the
    hash of the full context, and the word's number. Contexts reach back to the word's edge, no further."""
    codes = np.concatenate([np.frombuffer(f"\1{w}\1".encode("utf-32-le"), np.uint32) for w in words]).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(place > 0)
    hashes, context = [], []
    key, history = np.full(len(at), 7, np.uint64), np.full(len(at), 7, np.uint64)
    for order in range(1, ORDER + 1):
        # Order 1 is the character itself; each further order adds the character before.
        reach = place[at] >= order - 1
        step = np.where(reach, codes[np.maximum(at - order + 1, 0)] + np.uint64(2), np.uint64(0))
        key = _mix(key, step)
        if order > 1:
            history = _mix(history, step)
        hashes.append(key.copy())
        context.append(history.copy())
    return hashes, context, owner[at]


def _mix(key: np.ndarray, step: np.ndarray) -> np.ndarray:
    key = (key ^ step) * _BASE
    return key ^ (key >> np.uint64(29))


class _Model:
    """Tables of all languages: per order the sorted n-gram hashes with log2 probabilities, and the sorted
    context hashes with log2 back-off weights."""

    def __init__(self, languages: list[str], samples: dict[str, list[tuple[str, int]]]):
        self.languages = languages
        per = []
        for language in languages:
            words, counts = zip(*samples[language])
            hashes, context, owner = _grams(list(words))
            per.append((hashes, context, np.array(counts, np.int64)[owner]))
        self.grams, self.contexts, self.logs, self.weights = [], [], [], []
        letters = np.unique(np.concatenate([h[0][0] for h in per])) if per else np.empty(0, np.uint64)
        self.floor = -np.log2(len(letters) + 1)
        for order in range(ORDER):
            grams = np.unique(np.concatenate([h[order] for h, _, _ in per])) if per else letters
            contexts = np.unique(np.concatenate([c[order] for _, c, _ in per])) if per else letters
            # The (order-1)-gram below each n-gram: it ends in the same character and has the shorter context.
            logs = np.full((len(grams), len(languages)), 0.0)
            weights = np.zeros((len(contexts), len(languages)))
            below, history = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
            for hashes, context, _ in per:
                g = np.searchsorted(grams, hashes[order])
                history[g] = np.searchsorted(contexts, context[order])
                if order:
                    below[g] = np.searchsorted(self.grams[-1], hashes[order - 1])
            lower = 2.0 ** (self.logs[-1][below] if order else np.full((len(grams), len(languages)), self.floor))
            for column, (hashes, context, many) in enumerate(per):
                g = np.searchsorted(grams, hashes[order])
                if order == ORDER - 1:
                    count = np.bincount(g, many, len(grams))
                else:  # continuation counts: in how many different longer n-grams it stands
                    longer = np.unique(np.column_stack([g.astype(np.uint64), hashes[order + 1]]), axis=0)
                    count = np.bincount(longer[:, 0].astype(np.int64), minlength=len(grams)).astype(float)
                once, twice = (count == 1).sum(), (count == 2).sum()
                discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
                total = np.bincount(history, count, len(contexts))
                kinds = np.bincount(history, count > 0, len(contexts))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                share = np.where(total[history] > 0, np.maximum(count - discount, 0) / np.maximum(total[history], 1), 0)
                logs[:, column] = np.log2(share + weight[history] * lower[:, column])
                weights[:, column] = np.log2(weight)
            self.grams.append(grams)
            self.contexts.append(contexts)
            self.logs.append(logs)
            self.weights.append(weights)
        self.temperature, self.limits = 1.0, np.full(len(languages), np.inf)

    def costs(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)))
        hashes, context, owner = _grams(words)
        result = np.zeros((len(owner), len(self.languages)))
        left = np.arange(len(owner))
        for order in range(ORDER - 1, -1, -1):
            if not len(left) or not len(self.grams[order]):
                break
            wanted = hashes[order][left]
            at = np.minimum(np.searchsorted(self.grams[order], wanted), len(self.grams[order]) - 1)
            known = self.grams[order][at] == wanted
            result[left[known]] += self.logs[order][at[known]]
            left = left[~known]
            wanted = context[order][left]
            at = np.minimum(np.searchsorted(self.contexts[order], wanted), len(self.contexts[order]) - 1)
            seen = self.contexts[order][at] == wanted
            result[left[seen]] += self.weights[order][at[seen]]
        result[left] += self.floor
        return np.column_stack([np.bincount(owner, -column, len(words)) for column in result.T])


class _Scorer:
    """Costs of words, kept in the worker up to a fixed number."""

    def __init__(self, model: _Model, most: int = 400_000):
        self.model, self.most = model, most
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: bits per letter (edges count as one letter per word) under each language, and letters."""
        split = [word_letters(text) for text in texts]
        unknown = list(set().union(*split).difference(self.number))
        if len(self.number) + len(unknown) > self.most:
            self.number, self.table = {}, self.table[:0]
            unknown = list(set().union(*split))
        if unknown:
            self.number.update(zip(unknown, range(len(self.number), len(self.number) + len(unknown))))
            self.table = np.concatenate([self.table, self.model.costs(unknown)])
        find = self.number.__getitem__
        bits, letters = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for i, words in enumerate(split):
            if words:
                bits[i] = self.table[np.fromiter(map(find, words), np.int64, len(words))].sum(0)
                letters[i] = sum(map(len, words)) + len(words)
        return bits / np.maximum(letters, 1)[:, None], letters


def _sample(rows: DataFrame, most_chars: int) -> dict[str, list[tuple[str, int]]]:
    """Word counts of at most about `most_chars` characters of training text per language: each row is drawn
    by a hash with the probability that makes that many characters. The row with the smallest hash among those with
    text is always taken, its first `most_chars` characters if it was not drawn, so no language goes without."""
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sizes = rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"),
                                     F.min(F.when(F.char_length("text") > 0, draw)).alias("_first"))
    share = sizes.select("lang", F.least(F.lit(1.0), most_chars / F.greatest("chars", F.lit(1))).alias("_share"), "_first")
    drawn = draw < F.col("_share")
    chosen = (rows.join(F.broadcast(share), "lang").where(drawn | (draw == F.col("_first")))
              .select("lang", F.when(drawn, F.col("text")).otherwise(F.substring("text", 1, most_chars)).alias("text")))

    def words(batches):
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word in word_letters(text):
                    counts[language, word] = counts.get((language, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    found: dict[str, list[tuple[str, int]]] = {}
    for language, word, n in (chosen.mapInArrow(words, "lang string, word string, n bigint")
                              .groupBy("lang", "word").agg(F.sum("n")).collect()):  # bounded by most_chars
        found.setdefault(language, []).append((word, int(n)))
    return found


def identify(docs: DataFrame, folds: int = 5, most_chars: int = 1_500_000, calibration_texts: int = 500,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, accepted, bits_per_letter.

    Learns from rows that are not held out and have a language, at most about `most_chars` characters per
    language (a bounded sample for the classifier); predictions see the text alone. A missing text or one
    without a letter is `und` with score 0 and not accepted; so is every text if there is nothing to learn from.
    """
    spark = docs.sparkSession
    lang = F.col(f"`{lang_col}`").cast("string").alias("lang")
    rows = keyed(docs, id_col, text_col)
    training = (docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), lang)
                .where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds)))
    reachable(spark)
    samples = _sample(training, most_chars)
    model = _Model(sorted(samples), samples)
    if samples:
        _calibrate(model, training, calibration_texts)
    sent = spark.sparkContext.broadcast(model)  # bounded by most_chars per language

    def predict(batches):
        scorer = _Scorer(sent.value)
        names = sent.value.languages
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in slices(texts):
                out = {"lang_pred": [], "score": [], "accepted": [], "bits_per_letter": []}
                entropy, letters = scorer.entropies(texts[low:high])
                for bits, n in zip(entropy, letters):
                    if n and names:
                        best = int(bits.argmin())
                        odds = np.exp((bits[best] - bits) * sent.value.temperature)
                        out["lang_pred"].append(names[best])
                        out["score"].append(float(1 / odds.sum()))
                        out["accepted"].append(bool(bits[best] <= sent.value.limits[best]))
                        out["bits_per_letter"].append(float(bits[best]))
                    else:
                        for key, value in zip(out, ("und", 0.0, False, None)):
                            out[key].append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(low, high - low) for c in ("doc_id", "held_out")]
                    + [pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64()),
                       pa.array(out["accepted"], pa.bool_()), pa.array(out["bits_per_letter"], pa.float64())],
                    ["doc_id", "held_out", *out])

    return (rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text")
            .mapInArrow(predict, f"doc_id {id_type(rows)}, held_out boolean, lang_pred string, score double, "
                                 "accepted boolean, bits_per_letter double"))


def _calibrate(model: _Model, training: DataFrame, texts: int) -> None:
    """Temperature and rejection limits from about `texts` whole training texts per language."""
    draw = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    share = training.groupBy("lang").agg((texts / F.count("*")).alias("_share"))
    picked = training.join(F.broadcast(share), "lang").where(draw < F.col("_share")).select("lang", "text")
    sent = training.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        scorer = _Scorer(sent.value)
        for batch in batches:
            entropy, letters = scorer.entropies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(letters)],
                ["lang", "bits", "letters"])

    found = picked.mapInArrow(measure, "lang string, bits array<double>, letters bigint").where("letters > 0").collect()
    found = [r for r in found if r["lang"] in model.languages]
    if not found:
        return
    entropy, truth = np.array([r["bits"] for r in found]), np.array([model.languages.index(r["lang"]) for r in found])

    def loss(t: float) -> float:
        scaled = -(entropy - entropy.min(1, keepdims=True)) * t
        return float((np.log(np.exp(scaled).sum(1)) - scaled[np.arange(len(truth)), truth]).mean())

    model.temperature = min((1.0, 2.0, 4.0, 8.0, 16.0), key=loss)
    for column in range(len(model.languages)):
        own = entropy[truth == column, column]
        if len(own):
            model.limits[column] = np.quantile(own, 0.995) * 1.15
