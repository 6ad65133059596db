"""Best-fit packing of token sequences in bulk-synchronous steps.

Pieces of one length are interchangeable, and so are gaps of one size, so a step matches size classes:
pieces are range-sorted by length and ranked inside it, gaps are kept sorted by size, a successor sweep
gives each length the smallest gap that holds it, pieces that want the same gap are told apart by rank,
the gaps shrink, and the next length follows. With a capacity of C there are at most C classes on either
side whatever the number of documents, so the sweep itself handles a few thousand numbers; ranking
pieces and moving them into their places is distributed. The outcome is that of best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.llm import encoders
from crossmarket.llm.common import Scratch, id_type, keeps, keyed


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                 most_words: int = 1_500_000) -> DataFrame:
    """One row per piece of at most `capacity` tokens: its document, number, start, length and checksum.

    A document is its ids and the end id. An empty or missing text is the end id alone. Only documents
    above the capacity are cut, and only their last piece is shorter. `with_ids` adds the ids as bytes.
    A Python worker remembers the ids of at most `most_words` words.
    """
    rows = keyed(docs, id_col, text_col)
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def pieces(batches):
        keeps("encoders", encoders.forget)
        encoder = encoders.word_ids(tokenizer, most_words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in encoders.slices(texts):
                which, number, start, length, crc, ids = [], [], [], [], [], []
                for i, encoded in enumerate(encoder.encode(texts[low:high]), low):
                    encoded += end
                    for k, at in enumerate(range(0, len(encoded), width)):
                        piece = encoded[at:at + width]
                        which.append(i)
                        number.append(k)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            ids.append(piece)
                arrays = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(number, pa.int32()),
                          pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {id_type(rows)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(pieces, schema + (", ids binary" if with_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for so many pieces of each length: (length, first rank, pieces, first sequence, pieces each, offset).

    Piece number first + i of a row goes to sequence first sequence + i // each, at offset + (i % each) * length.
    """
    sizes: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, places = 0, []

    def leave(size: int, first: int, many: int) -> None:
        if size and many:
            if size not in gaps:
                insort(sizes, size)
            gaps.setdefault(size, []).append((first, many))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(sizes, length)
            size = sizes[at] if at < len(sizes) else capacity
            each = size // length
            wanted = -(-(total - rank) // each)
            if at < len(sizes):
                first, many = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                first, many, opened = opened, wanted, opened + wanted
            used = min(many, wanted)
            placed = min(total - rank, used * each)
            places.append((length, rank, placed, first, each, capacity - size))
            full = placed // each
            leave(size - each * length, first, full)
            leave(size - (placed - full * each) * length, first + full, used - full)
            leave(size, first + used, many - used)
            rank += placed
    return places


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_share: int = 50_000) -> DataFrame:
    """The pieces with their sequence and offset; every piece is placed, gapless from 0.

    `pieces` needs `doc_id`, `piece`, `start`, `length` (1 to capacity). Ranks inside a length are counted in shares
    of the rows, so a length that a third of all pieces have is split too. Ties between equal pieces are broken by
    id, number and start; repeated rows are each placed. An empty table gives an empty one. Other columns, which
    may be wide, stay out of ranking and placing and join their piece at the end.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    wide = [c for c in pieces.columns if c not in ("doc_id", "piece", "start", "length", "ids_crc32")]
    if wide:
        whole = scratch.cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
        placed = _placed(whole.drop(*wide), capacity, rows_per_share).hint("shuffle_hash")
        return (whole.select("_row", *wide).join(placed, "_row")
                .select(*pieces.columns, "sequence_id", "offset"))
    return _placed(scratch.cut(pieces), capacity, rows_per_share)


def _placed(pieces: DataFrame, capacity: int, rows_per_share: int) -> DataFrame:
    """`pack` for narrow rows that are written already."""
    spark, rows = pieces.sparkSession, pieces
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = np.array(sweep(counts, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shares = max(8, -(-sum(counts.values()) // rows_per_share))
    share = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shares)).alias("_share")
    rows = rows.select("*", share)
    before = (rows.groupBy("length", "_share").count()
              .select("length", "_share", (F.sum("count").over(Window.partitionBy("length").orderBy("_share"))
                                           - F.col("count")).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "start"))
    ranked = (rows.withColumn("_rank", inside - 1).join(before, ["length", "_share"])
              .select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank")))
    sent = spark.sparkContext.broadcast(plan)  # bounded by the capacity, not by the documents

    def place(batches):
        plan = sent.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            inside = rank - row[:, 1]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(row[:, 3] + inside // row[:, 4]),
                 pa.array(row[:, 5] + (inside % row[:, 4]) * length)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                     most_words: int = 1_500_000) -> DataFrame:
    """Whole documents, tokenized and packed; see `token_pieces` and `pack`."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids, most_words), capacity)
