"""Hard negatives by Strassen multiplication of integer tiles and mergeable heaps.

1. Vectors become integer rows, floor(scale * x), and are written as tiles: a few hundred rows of one matrix
   with their ids and labels. Vectors shorter than the longest are padded with zeros, which add nothing.
2. Anchors are numbered and taken in blocks of bounded size. A block is broadcast; every task multiplies it with
   its tiles by Strassen's recursion. All sums are int64 and may wrap inside the recursion: addition modulo 2^64
   is exact, and the limit on components keeps each finished product within 63 bits.
3. Every task keeps, per anchor, a heap of the best rows of the anchor's label. Heaps are merged by Spark.
4. With the positives of a block known, a second pass keeps a heap per anchor and positive of the rows of
   other labels whose score lies in the positive's window. These are merged in the same way.

No step holds more than a block of anchors, a tile and the heaps, and no row is left out of any comparison.
"""

from __future__ import annotations

from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch, dense_numbers, id_type

LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """a times the transpose of b, both int64; odd edges are padded with a row or column of zeros."""
    (m, k), n = a.shape, b.shape[0]
    if min(m, k, n) <= leaf:
        return a @ b.T
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if n % 2 or k % 2:
        b = np.pad(b, ((0, n % 2), (0, k % 2)))
    i, j, h = a.shape[0] // 2, b.shape[0] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b21, b12, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]  # of the transpose
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j], out[:i, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :j], out[i:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best `size` entries of every group: higher scores first, ties by smaller id.

    Kept as arrays sorted by group, so all groups of a tile are merged in one sort.
    """

    def __init__(self, groups: int, size: int):
        self.size, self.least = size, np.full(groups, LEAST)
        self.group, self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), None

    def offer(self, groups: np.ndarray, scores: np.ndarray, inside: np.ndarray, ids: np.ndarray) -> None:
        """One row of scores per group, all over the same `ids`; only entries `inside` count."""
        masked = np.where(inside, scores, LEAST)
        floor = self.least[groups]
        if len(ids) > self.size:  # at most the best of this tile, with all that tie with the last of them
            floor = np.maximum(floor, np.partition(masked, len(ids) - self.size, axis=1)[:, len(ids) - self.size])
        row, col = np.nonzero(inside & (masked >= floor[:, None]))
        if not len(row):
            return
        self.ids = ids[:0] if self.ids is None else self.ids
        group = np.concatenate([self.group, groups[row]])
        score, names = np.concatenate([self.score, scores[row, col]]), np.concatenate([self.ids, ids[col]])
        order = np.lexsort((names, -score, group))
        group, score, names = group[order], score[order], names[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        kept = rank < self.size
        last = rank == self.size - 1
        self.least[group[last]] = score[last]
        self.group, self.score, self.ids = group[kept], score[kept], names[kept]


def _tiles(rows: DataFrame, width: int, scale: int, rows_per_tile: int) -> DataFrame:
    """Vectors that take part, as tiles: row numbers, ids, labels, anchor marks and the matrix (int32)."""
    limit = min(isqrt((2 ** 63 - 1) // max(width, 1)), 2 ** 31 - 1)
    step = max(1, min(rows_per_tile, 2 ** 22 // max(width, 1)))

    def cut(batches):
        first, number = TaskContext.get().partitionId() << 33, count()
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                vectors = part.column("vector")
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                row = np.repeat(np.arange(part.num_rows), lengths)
                values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                good = np.ones(part.num_rows, bool)
                good[row[~(np.abs(values) <= limit)]] = False  # missing, not a number, infinite or too large
                matrix = np.zeros((part.num_rows, width), np.int32)
                fine = good[row]
                matrix[row[fine], (np.arange(len(row)) - starts[row])[fine]] = values[fine]
                n = int(good.sum())
                if not n:
                    continue
                keys = np.fromiter((first + next(number) for _ in range(n)), np.int64, n)
                one, mask = pa.array([0, n], pa.int32()), pa.array(good)
                columns = [part.column(c).filter(mask) for c in ("id", "label", "anchor")]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, c) for c in (pa.array(keys), *columns)]
                    + [pa.array([matrix[good].tobytes()], pa.binary())], ["keys", "ids", "labels", "anchors", "matrix"])

    return rows.mapInArrow(cut, f"keys array<bigint>, ids array<{id_type(rows, 'id')}>, "
                                f"labels array<{id_type(rows, 'label')}>, anchors array<boolean>, matrix binary")


def _anchors(tiles: DataFrame, width: int, ids: str, labels: str) -> DataFrame:
    """One row per anchor, its vector as bytes."""
    def pick(batches):
        for batch in batches:
            for tile in batch.to_pylist():
                at = [i for i, marked in enumerate(tile["anchors"]) if marked]
                matrix = np.frombuffer(tile["matrix"], np.int32).reshape(-1, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile["keys"][i] for i in at], pa.int64()),
                     pa.array([tile["ids"][i] for i in at], batch.schema.field("ids").type.value_type),
                     pa.array([tile["labels"][i] for i in at], batch.schema.field("labels").type.value_type),
                     pa.array([matrix[i].tobytes() for i in at], pa.binary())], ["key", "id", "label", "vector"])

    marked = tiles.where(F.exists("anchors", lambda x: x))
    return marked.mapInArrow(pick, f"key bigint, id {ids}, label {labels}, vector binary")


def _scored(batches, block: dict, width: int):
    """Tile by tile: scores of the block's anchors, ids, which rows share the label, which row is the anchor's own."""
    codes = {label: i for i, label in enumerate(dict.fromkeys(block["label"]))}
    own = np.array([codes[label] for label in block["label"]])
    keys = np.array(block["key"], np.int64)
    matrix = np.frombuffer(b"".join(block["vector"]), np.int32).reshape(-1, width).astype(np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.array(batch.column("ids")[i].as_py())
            theirs = np.array([codes.get(label, -1) for label in batch.column("labels")[i].as_py()])
            tile = np.frombuffer(batch.column("matrix")[i].as_py(), np.int32).reshape(-1, width).astype(np.int64)
            same = own[:, None] == theirs[None, :]
            itself = keys[:, None] == np.array(batch.column("keys")[i].as_py())[None, :]
            yield strassen(matrix, tile), ids, same, itself


def _merged(heaps: DataFrame, size: int, group: str = "slot") -> DataFrame:
    """The heaps of all tasks as one: the best entries of a group are among the best of every task."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(vectors: DataFrame, anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256, block_bytes: int = 4 << 20, rows_per_tile: int = 1024) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels in the positive's window.

    `anchor` is a condition on the rows of `vectors`. An anchor's positives are the `positives` best other rows of its
    label by integer inner product, ties by smaller id; a negative's score s satisfies low * p <= 100 * s <= high * p.
    Rows without an id or a label, without a vector, or with a missing or non-finite component take no part;
    neither do rows with a component beyond the square root of 2^63 / width after scaling, whose products would not
    fit a long. A missing `anchor` condition counts as false. Shorter vectors end in zeros. A repeated row is a row of its own: it is an anchor and a
    positive of its copy. Anchors without positives, and positives without rows in their window, have no row.
    An empty table gives an empty result. Other columns are not read.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    marked = F.expr(anchor) if isinstance(anchor, str) else anchor
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                          F.coalesce(marked, F.lit(False)).alias("anchor"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    ids, labels = id_type(rows, "id"), id_type(rows, "label")
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    tiles = scratch.cut(_tiles(rows, width, scale, rows_per_tile))
    numbered = dense_numbers(_anchors(tiles, width, ids, labels), scratch)
    size = max(1, block_bytes // (8 * width))
    blocks = -(-numbered.count() // size)
    schema = f"anchor_id {ids}, positive_id {ids}, rank int, negative_id {ids}, positive_score bigint, negative_score bigint"

    def found(number: int) -> DataFrame:
        part = numbered.where(F.col("number").between(number * size, number * size + size - 1)).orderBy("number")
        block = part.select("key", "id", "label", "vector").toArrow().to_pydict()  # at most block_bytes
        sent = spark.sparkContext.broadcast(block)

        def nearest(batches):
            heaps = Heaps(len(sent.value["key"]), positives)
            every = np.arange(len(sent.value["key"]))
            for scores, names, same, itself in _scored(batches, sent.value, width):
                heaps.offer(every, scores, same & ~itself, names)
            yield emitted(heaps)

        def emitted(heaps: Heaps) -> pa.RecordBatch:
            names = [] if heaps.ids is None else heaps.ids.tolist()
            return pa.RecordBatch.from_arrays([pa.array(heaps.group), pa.array(heaps.score), pa.array(names, id_arrow)],
                                              ["slot", "score", "id"])

        id_arrow = _arrow_type(tiles)
        heap_schema = f"slot bigint, score bigint, id {ids}"
        best = _merged(tiles.select("keys", "ids", "labels", "matrix").mapInArrow(nearest, heap_schema), positives)
        pairs = best.orderBy("slot", "rank").select("slot", "score", "id").toArrow().to_pydict()  # positives per anchor
        windows = spark.sparkContext.broadcast(pairs)

        def between(batches):
            slot, score = (np.array(windows.value[c], np.int64) for c in ("slot", "score"))
            # Exact also where 100 times a score is beyond 63 bits.
            least = np.array([-(-low * p // 100) for p in windows.value["score"]], np.int64)
            most = np.array([high * p // 100 for p in windows.value["score"]], np.int64)
            turn = np.arange(len(slot)) - np.searchsorted(slot, slot)
            heaps = Heaps(len(slot), negatives)
            for scores, names, same, _ in _scored(batches, sent.value, width):
                for k in range(positives):
                    pair = np.flatnonzero(turn == k)
                    if not len(pair):
                        break
                    ours, others = scores[slot[pair]], ~same[slot[pair]]
                    heaps.offer(pair, ours, others & (ours >= least[pair, None]) & (ours <= most[pair, None]), names)
            yield emitted(heaps)

        kept = _merged(tiles.select("keys", "ids", "labels", "matrix").mapInArrow(between, heap_schema), negatives)

        def named(batches):
            anchors, pairs = sent.value["id"], windows.value
            for batch in batches:
                at = batch.column("slot").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchors[pairs["slot"][i]] for i in at], id_arrow),
                     pa.array([pairs["id"][i] for i in at], id_arrow), batch.column("rank").cast(pa.int32()),
                     batch.column("id"), pa.array([pairs["score"][i] for i in at], pa.int64()), batch.column("score")],
                    ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        return kept.mapInArrow(named, schema)

    if blocks <= 1:
        return found(0) if blocks else spark.createDataFrame([], schema)
    paths = [scratch.write(found(b))[1] for b in range(blocks)]
    return spark.read.schema(schema).parquet(*paths)


def _arrow_type(tiles: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(tiles.schema["ids"].dataType.elementType)


ORACLE_SQL = """
    WITH taken AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
           score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
