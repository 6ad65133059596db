"""Brown class bigram model: exchange clustering, class transitions and word emissions, all counted on Spark.

1. Tasks cut their documents into blocks and number the words of a block, so a text is split once and
   travels as numbers; a block's words are few beside its tokens.
2. Word counts are summed over all blocks and joined back to the blocks that hold the word.
3. Words seen at least `min_count` times in training are clustered, so the clustering grows with the corpus. Their
   classes are a Spark table, joined to the words of the blocks for each pass. Rarer words keep a class given by
   their last letters.
4. An exchange round counts, for every clustered word, the classes before and after it over all
   training documents, as sparse rows; words are spread over tasks, and each moves to the class that raises the
   likelihood of the class bigrams most. The clustering with the highest likelihood is kept.
5. A text's score is the sum of log10 p(class | class before) p(word | class), end of text included.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch, held_out, id_type, keyed

END = b""  # no word is empty
RARE = 15  # classes of words outside the clustering, by the checksum of their last three letters


def _numbered(rows: DataFrame, block_chars: int) -> DataFrame:
    """Two kinds of rows: documents as word numbers of their block, and the words of each block with their
    training counts. Words are what stands between ASCII white space, A-Z lower-cased."""

    def number(batches):
        task, blocks = TaskContext.get().partitionId() << 32, count()
        held, encoded, chars = [], [], 0
        ids: list[pa.Array] = []
        words = defaultdict(count().__next__)

        def flush():
            nonlocal held, encoded, chars, ids, words
            block = task + next(blocks)
            train = np.concatenate([e for e, h in zip(encoded, held) if not h] or [np.empty(0, np.int32)])
            seen = np.bincount(train, minlength=len(words))
            ends = sum(not h for h in held)
            names = [*words, END]
            n, w = len(encoded), len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.concat_arrays(ids), pa.array(held, pa.bool_()),
                 pa.array([e.tobytes() for e in encoded], pa.binary()), pa.nulls(n, pa.int32()),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * w, pa.int64()), pa.nulls(w, ids[0].type), pa.nulls(w, pa.bool_()),
                 pa.nulls(w, pa.binary()), pa.array(np.arange(w, dtype=np.int32)), pa.array(names, pa.binary()),
                 pa.array(np.append(seen, ends))], columns)
            held, encoded, chars, ids, words = [], [], 0, [], defaultdict(count().__next__)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            apart = batch.column("held_out").to_pylist()
            start = 0
            for i, text in enumerate(texts):
                found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
                encoded.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                held.append(apart[i])
                chars += len(text)
                if chars >= block_chars:
                    ids.append(batch.column("doc_id").slice(start, i + 1 - start))
                    start = i + 1
                    yield from flush()
            ids.append(batch.column("doc_id").slice(start))
        if encoded:
            yield from flush()

    columns = ["block", "doc_id", "held_out", "ids", "number", "word", "n"]
    return rows.mapInArrow(number, f"block bigint, doc_id {id_type(rows)}, held_out boolean, ids binary, "
                                   "number int, word binary, n bigint")


def _class_of(words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block's words in the order of their numbers, and the class of each number."""
    order = np.argsort(words.column("number").to_numpy())
    return order, words.column("class").to_numpy()[order].astype(np.int64)


def _contexts(documents: DataFrame, labelled: DataFrame, classes: int) -> DataFrame:
    """Rows (id, class, cells), one per block and clustered word: cells (see _packed) are pairs (slot, n) that say how
    often the word stands after class `slot`, before class `slot - classes`, and (slot 2 * classes) after itself.
    The row with id -1 holds the block's class bigram matrix, n tokens of class slot % classes after slot // classes."""
    end, wide = classes - 1, 2 * classes + 1

    def tally(documents: pa.Table, words: pa.Table) -> pa.Table:
        order, class_of = _class_of(words)
        ids = words.column("id").to_numpy()[order]  # -1: not clustered
        stop, matrix, parts = len(ids) - 1, np.zeros(classes * classes, np.int64), []
        for flat in _slices(documents.column("ids"), stop):
            now = class_of[flat]
            before = np.append(end, now[:-1])
            matrix += np.bincount(before * classes + now, minlength=classes * classes)
            mine = ids[flat] >= 0
            row = flat.astype(np.int64) * wide
            same = mine[1:] & (flat[1:] == flat[:-1])
            keys = np.concatenate([(row + before)[mine], row[:-1][mine[:-1]] + classes + now[1:][mine[:-1]],
                                   row[1:][same] + 2 * classes])
            parts.append(np.unique(keys, return_counts=True))
        keys, n = _merged(parts)
        word, slot = np.divmod(keys, wide)
        cells = np.flatnonzero(matrix)
        word, mine = _packed(word, slot, n)
        _, sums = _packed(cells, cells, matrix[cells])
        first = np.flatnonzero(np.diff(word, prepend=-1))
        word, pairs = word[first], np.concatenate([mine, sums])
        bounds = np.concatenate([first, [len(mine), len(pairs)]]).astype(np.int32) * 4
        packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(pairs)])
        return pa.table({"id": np.append(ids[word], -1), "class": np.append(class_of[word], -1).astype(np.int32),
                         "cells": packed})

    return (documents.where("not held_out").groupBy("block").cogroup(labelled.groupBy("block"))
            .applyInArrow(tally, "id bigint, class int, cells binary"))


MOST = (1 << 16) - 1  # of one cell; a slot is below 2^16 too, as there are at most 256 classes


def _packed(rows: np.ndarray, slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of each pair: 32 bits, n above and slot below. A greater n is dealt to several cells of its row."""
    if n.max(initial=0) > MOST:
        times = (n - 1) // MOST + 1
        rest = n - (times - 1) * MOST
        rows, slots, n = np.repeat(rows, times), np.repeat(slots, times), np.full(times.sum(), MOST)
        n[np.cumsum(times) - 1] = rest
    return rows, (n << 16 | slots).astype("<u4")


def _pairs(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and n of all pairs in a column of cells, read where the column holds them."""
    _, bounds, held = cells.cast(pa.binary()).buffers()
    bounds = np.frombuffer(bounds, np.int32)[cells.offset:cells.offset + len(cells) + 1] // 4
    pairs = np.frombuffer(held or b"", "<u4", int(bounds[-1]))[bounds[0]:].astype(np.int64)
    return np.repeat(np.arange(len(cells)), np.diff(bounds)), pairs & MOST, pairs >> 16


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts, of parts with distinct keys each."""
    keys, n = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *parts))
    if len(parts) < 2:
        return keys, n
    width = int(n.max(initial=1)).bit_length()
    if int(keys.max(initial=0)).bit_length() + width > 63:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    else:  # sorted as one number each, which is several times faster than sorting an order
        both = np.sort(keys << width | n)
        keys, n = both >> width, both & ((1 << width) - 1)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _slices(texts: pa.ChunkedArray, stop: int, tokens: int = 1_000_000):
    """Word numbers of whole texts in a row, each text closed by `stop`, about so many tokens at a time."""
    part, size = [], 0
    for text in texts.to_pylist():
        part += [np.frombuffer(text, np.int32), np.array([stop], np.int32)]
        size += len(text) // 4 + 1
        if size >= tokens:
            yield np.concatenate(part)
            part, size = [], 0
    if part:
        yield np.concatenate(part)


def _coded(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """Documents as the classes of their words, a byte each, with the sum of log10(count + 0.1) over their tokens and
    how many tokens were seen in training."""
    def code(documents: pa.Table, words: pa.Table) -> pa.Table:
        order, class_of = _class_of(words)
        seen, short = words.column("c").to_numpy()[order], class_of.astype(np.uint8)
        value, known, end = np.log10(seen + 0.1), seen > 0, len(seen) - 1
        out = {"n_tokens": [], "n_known": [], "log_sum": [], "classes": []}
        for ids in documents.column("ids").to_pylist():
            ids = np.frombuffer(ids, np.int32)
            out["n_tokens"].append(len(ids) + 1)
            out["n_known"].append(int(known[ids].sum()) + int(known[end]))
            out["log_sum"].append(float(value[ids].sum() + value[end]))
            out["classes"].append(short[ids].tobytes())
        return pa.table({"doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"),
                         "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                         "n_known": pa.array(out["n_known"], pa.int64()),
                         "log_sum": pa.array(out["log_sum"], pa.float64()),
                         "classes": pa.array(out["classes"], pa.binary())})

    return (documents.groupBy("block").cogroup(labelled.groupBy("block"))
            .applyInArrow(code, f"doc_id {id_type(documents)}, held_out boolean, n_tokens bigint, n_known bigint, "
                                "log_sum double, classes binary"))


def _steps(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each token of all texts in a row, of the token before, and the lengths; an end closes each text."""
    texts = [np.frombuffer(x, np.uint8) for x in batch.column("classes").to_pylist()]
    stop = np.array([end], np.uint8)
    now = np.concatenate([part for x in texts for part in (x, stop)]).astype(np.int64)
    return now, np.append(end, now[:-1]), np.array([len(x) + 1 for x in texts])


def _matrix(rows: DataFrame, classes: int, flat_counts) -> np.ndarray:
    """The class bigram matrix, summed in tasks, then by Spark; `flat_counts` gives a batch's part of it."""
    def tally(batches):
        matrix = np.zeros(classes * classes, np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix += flat_counts(batch)
        cells = np.flatnonzero(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(matrix[cells])], ["cell", "n"])

    result = np.zeros(classes * classes, np.int64)
    for cell, n in rows.mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        result[cell] = n  # a row per cell of the matrix
    return result.reshape(classes, classes)


def _matrix_of_contexts(contexts: DataFrame, classes: int) -> np.ndarray:
    def flat_counts(batch):
        _, slot, n = _pairs(batch.column("cells"))
        return np.bincount(slot, weights=n, minlength=classes * classes).astype(np.int64)

    return _matrix(contexts.where("id < 0").select("cells"), classes, flat_counts)


def _matrix_of_texts(coded: DataFrame, classes: int) -> np.ndarray:
    def flat_counts(batch):
        now, before, _ = _steps(batch, classes - 1)
        return np.bincount(before * classes + now, minlength=classes * classes)

    return _matrix(coded.where("not held_out").select("classes"), classes, flat_counts)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What the choice of classes changes in the log-likelihood of the corpus."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def gains(matrix: np.ndarray, now: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray,
          clustered: int) -> np.ndarray:
    """Likelihood of each class for each word, up to a constant of the word: what adding it there gains once it is
    taken out of its class `now`. `left` and `right` (a row per word) leave the word's own repetitions out."""
    words = np.arange(len(now))
    total = np.zeros((len(now), clustered))
    for cells, outer, inner in ((matrix, right, left), (matrix.T, left, right)):
        b, slot = np.nonzero(outer)
        n = outer[b, slot][:, None]
        without = cells[:clustered, slot].T.copy()
        without[np.arange(len(b)), now[b]] -= n[:, 0]
        here = np.flatnonzero(slot == now[b])  # the word's own class, as its neighbour, loses it too
        without[here] -= inner[b[here], :clustered]
        without[here, now[b[here]]] -= own[b[here]]
        first = np.flatnonzero(np.diff(b, prepend=-1))
        if len(first):
            total[b[first]] += np.add.reduceat(_xlogx(without + n) - _xlogx(without), first)
        sums, extra = np.tile(cells.sum(1)[:clustered], (len(now), 1)), outer.sum(1) + own
        sums[words, now] -= extra
        total -= _xlogx(sums + extra[:, None]) - _xlogx(sums)
    corner = np.tile(matrix.diagonal()[:clustered], (len(now), 1))
    corner[words, now] -= right[words, now] + left[words, now] + own
    r, l, o = right[:, :clustered], left[:, :clustered], own[:, None]
    return total + _xlogx(corner + r + l + o) + _xlogx(corner) - _xlogx(corner + r) - _xlogx(corner + l)


def move(matrix: np.ndarray, now: np.ndarray, vectors: np.ndarray, clustered: int) -> np.ndarray:
    """The class each word gains most in, all against the same matrix, which is then updated for the moves."""
    words, classes = np.arange(len(now)), len(matrix)
    left, right, own = vectors[:, :classes].copy(), vectors[:, classes:-1].copy(), vectors[:, -1]
    left[words, now] -= own
    right[words, now] -= own
    gain = gains(matrix, now, left, right, own, clustered)
    new = gain.argmax(1)
    new = np.where(gain[words, new] > gain[words, now] + 1e-9, new, now)
    change = np.zeros((len(now), classes))
    np.add.at(change, (words, new), 1)
    np.add.at(change, (words, now), -1)
    matrix += change.T @ right + left.T @ change + np.diag(change.T @ own)
    return new


def _whole_words(batches, wide: int):
    """Ids, classes and summed vectors of words whose rows, from one or more blocks, follow one another."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, now = (batch.column(c).to_numpy() for c in ("id", "class"))
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        row, slot, n = _pairs(batch.column("cells"))
        vectors = np.bincount(word[row] * wide + slot, weights=n, minlength=len(first) * wide).reshape(-1, wide)
        ids, now = ids[first], now[first].astype(np.int64)
        if held and held[0][0] == ids[0]:
            vectors[0] += held[2][0]
        elif held:
            yield held
        if len(ids) > 1:
            yield ids[:-1], now[:-1], vectors[:-1]
        held = ids[-1:], now[-1:], vectors[-1:].copy()
    if held:
        yield held


def _groups(weights: np.ndarray, most: float, at_once: int):
    """Slices of at most so many words and so much weight; a heavier word is alone."""
    sums, start = np.append(0, np.cumsum(weights)), 0
    while start < len(weights):
        stop = int(np.searchsorted(sums, sums[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), start + at_once)
        yield slice(start, stop)
        start = stop


def _exchange(contexts: DataFrame, matrix: np.ndarray, clustered: int, at_once: int = 64) -> DataFrame:
    """New classes of the clustered words: spread over tasks, each task moving its words in small groups, one group
    after another; a group has at most a hundredth of all tokens, so frequent words move alone. A word has a row per
    block at most; they are summed as they pass."""
    def moves(batches):
        local = matrix.astype(np.float64)
        for ids, now, vectors in _whole_words(batches, 2 * len(matrix) + 1):
            new = [move(local, now[part], vectors[part], clustered)
                   for part in _groups(vectors[:, :len(matrix)].sum(1), matrix.sum() / 100, at_once)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(new).astype(np.int32))], ["id", "class"])

    return (contexts.where("id >= 0").repartition("id").sortWithinPartitions("id")
            .mapInArrow(moves, "id bigint, class int"))


class _Model:
    """What training gives: coded texts, the classes of the clustered words, and the class bigram matrix."""

    def __init__(self, docs: DataFrame, classes: int, rounds: int, min_count: int, folds: int, block_chars: int,
                 id_col: str, text_col: str):
        if classes + RARE >= 256:
            raise ValueError(f"at most {255 - RARE} classes")
        scratch = Scratch(docs.sparkSession, "class-lm")
        rows = keyed(docs, id_col, text_col)
        rows = rows.select("doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"))
        self.end = end = classes + RARE
        numbered, numbered_path = scratch.write(_numbered(rows, block_chars))
        documents = numbered.where("number is null").select("block", "doc_id", "held_out", "ids")
        words = numbered.where("number is not null").select("block", "number", "word", "n")
        is_end = F.octet_length("word") == 0
        kind = F.when(is_end, end).otherwise(classes + F.crc32(F.expr("right(word, 3)")) % RARE).cast("int")
        frequent = (F.col("c") >= min_count) & ~is_end
        self.vocabulary = scratch.cut(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0").select(
            "word", "c", kind.alias("kind"), F.when(frequent, F.monotonically_increasing_id()).alias("id")))
        self.total = self.vocabulary.agg(F.sum("c")).first()[0] or 0
        types = self.vocabulary.where("id is null").groupBy("kind").count().collect()  # a row per class
        words, words_path = scratch.write(
            words.join(self.vocabulary.select("word", "c", "id"), "word", "left")
            .select("block", "number", kind.alias("kind"), F.coalesce("c", F.lit(0)).alias("c"), "id"))

        def labelled(labels: DataFrame) -> DataFrame:
            other = words.where("id is null").select("block", "number", "c", F.lit(-1).cast("bigint").alias("id"),
                                                     F.col("kind").alias("class"))
            return other.unionByName(words.where("id is not null").join(labels, "id")
                                     .select("block", "number", "c", "id", "class"))

        self.labels = scratch.cut(self.vocabulary.where("id is not null").select(
            "id", F.pmod(F.xxhash64("word"), F.lit(classes)).cast("int").alias("class")))
        best = None
        for _ in range(rounds):
            contexts, path = scratch.write(_contexts(documents, labelled(self.labels), end + 1))
            matrix = _matrix_of_contexts(contexts, end + 1)
            if best is None or likelihood(matrix) > best[0]:
                best = likelihood(matrix), self.labels
            self.labels = scratch.cut(_exchange(contexts, matrix, classes))
            scratch.drop(path)
        self.coded, coded_path = scratch.write(_coded(documents, labelled(self.labels)))
        self.matrix = _matrix_of_texts(self.coded, end + 1)
        if best and best[0] > likelihood(self.matrix):  # the last round made it worse
            scratch.drop(coded_path)
            self.labels = best[1]
            self.coded = scratch.cut(_coded(documents, labelled(self.labels)))
            self.matrix = _matrix_of_texts(self.coded, end + 1)
        scratch.drop(numbered_path)
        scratch.drop(words_path)
        self.types = np.zeros(end + 1)
        for at, many in [*types, *self.labels.groupBy("class").count().collect()]:
            self.types[at] += many
        self.distinct = int(self.types.sum())
        self.types[classes:end] += 1  # words never seen
        self.types[end] = 1


def word_classes(docs: DataFrame, classes: int = 48, rounds: int = 3, min_count: int = 5, folds: int = 10,
                 block_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word of the training rows: word, its count, class, and whether it was clustered.

    Words below `min_count` keep one of the `RARE` classes after the clustered ones; the end of a text is the empty word
    and has the last class.
    """
    model = _Model(docs, classes, rounds, min_count, folds, block_chars, id_col, text_col)
    name = F.col("word").cast("string").alias("word")
    other = model.vocabulary.where("id is null").select(name, "c", F.col("kind").alias("class"), F.lit(False).alias("clustered"))
    return (model.vocabulary.where("id is not null").join(model.labels, "id")
            .select(name, "c", "class", F.lit(True).alias("clustered")).unionByName(other)
            .withColumnRenamed("c", "count"))


def score_texts(docs: DataFrame, classes: int = 48, rounds: int = 3, min_count: int = 5, folds: int = 10,
                block_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows whose id's checksum is 0 modulo `folds` are held out: scored, not learned from. A missing text is
    empty: its only token is the end. Repeated rows each count and are each scored; a missing id is a
    training row. An empty table gives an empty one.
    """
    model = _Model(docs, classes, rounds, min_count, folds, block_chars, id_col, text_col)
    end, total, matrix = model.end, model.total, model.matrix
    mass = np.log10(np.maximum(matrix.sum(0) + 0.1 * model.types, 0.1))
    steps = np.log10((matrix + 0.1) / (matrix.sum(1, keepdims=True) + 0.1 * (end + 1)))
    base = math.log10(total + 0.1 * (model.distinct + 1))

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            now, before, lengths = _steps(batch, end)
            value = steps[before, now] - mass[now]
            sums = np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            logs, n = batch.column("log_sum").to_numpy(), batch.column("n_tokens").to_numpy()
            result = sums + logs
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")),
                 pa.array(np.full(len(n), total, np.int64)), pa.array(logs - n * base), pa.array(result),
                 pa.array(10.0 ** (-result / n))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return model.coded.mapInArrow(score, f"doc_id {id_type(model.coded)}, held_out boolean, n_tokens bigint, "
                                         "n_known bigint, train_tokens bigint, base_score double, score double, "
                                         "perplexity double")
