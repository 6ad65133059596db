"""Exact token counts, huge documents in overlapping chunks that are resynchronised.

A document up to `chunk_chars` is counted at once. A longer one is cut into chunks that overlap; each
chunk is encoded in its own row, its overlaps with offsets, so no task needs the whole document. Where two chunks
overlap, the splice is the first place that is a token boundary in both encodings and a place where the
tokenizer starts a new word whatever stands around it (white space after a character that is none, a
mark after a Chinese or Japanese letter): the tokens before it cannot depend on what follows the left chunk,
nor those after it on what precedes the right one. A document in which some overlap has no such place is cut again with overlaps
eight times as wide; once they reach its length, one chunk holds all of it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmarket.llm import encoders
from crossmarket.llm.common import Scratch, id_type, keyed

_SEAM = re.compile("(?<=\\S)[ \t\n\r]|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])[\u3001\u3002\uff01\uff0c\uff1f]")


def _chunks(texts: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """(key, number, last, start, own, head, chunk): own characters, then the overlap into the next chunk.

    The first `head` characters are the overlap with the chunk before.
    """
    stride = max(chunk_chars, overlap)

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                whole = overlap >= len(text)
                starts = [0] if whole else range(0, len(text), stride)
                for number, start in enumerate(starts):
                    head = min(overlap, len(text) - start) if number else 0
                    yield pa.RecordBatch.from_pydict(
                        {"key": [key], "number": pa.array([number], pa.int64()),
                         "last": [number == len(starts) - 1], "start": pa.array([start], pa.int64()),
                         "own": pa.array([stride], pa.int64()), "head": pa.array([head], pa.int64()),
                         "chunk": [text if whole else text[start:start + stride + overlap]]})

    return texts.mapInArrow(
        cut, "key string, number bigint, last boolean, start bigint, own bigint, head bigint, chunk string")


def _encoded(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """Per chunk its token count and, inside both overlaps, the safe boundaries with the tokens before them."""

    def places(found: list[tuple[int, int]]) -> list[dict]:
        return [{"at": at, "before": before} for at, before in found]

    def starts(text: str) -> dict[int, int]:
        """Tokens before each character at which a token starts."""
        before: dict[int, int] = {}
        for i, (low, _) in enumerate(encoded := encoders.library(tokenizer).encode(text, add_special_tokens=False).offsets):
            before.setdefault(low, i)
        before[-1] = len(encoded)
        return before

    def encode(batches):
        counter = encoders.spaced_counts(tokenizer)
        pair = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            rows = batch.select(["start", "own", "head", "chunk"]).to_pydict()
            tokens, left, right = [], [], []
            for start, own, head, text in zip(rows["start"], rows["own"], rows["head"], rows["chunk"]):
                total = counter.count([text])[0]
                tokens.append(total)
                # The head is encoded with offsets: what stands before a safe place does not depend on what
                # follows. A chunk cannot see what precedes it, so its first character is no such place.
                before = starts(text[:head])
                left.append(places([(start + m.start(), before[m.start()]) for m in _SEAM.finditer(text[:head])
                                    if m.start() in before]))
                # The tail likewise, from the other side: tokens before are all but those from the place on.
                before = starts(text[own:])
                right.append(places([(start + own + m.start(), total - before[-1] + before[m.start()])
                                     for m in _SEAM.finditer(text[own:]) if m.start() in before]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "number", "last")), pa.array(tokens, pa.int64()),
                 pa.array(left, pair), pa.array(right, pair)],
                ["key", "number", "last", "tokens", "left", "right"])

    kind = "array<struct<at: bigint, before: bigint>>"
    return chunks.mapInArrow(
        encode, f"key string, number bigint, last boolean, tokens bigint, left {kind}, right {kind}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): chunk counts between splices; null where two chunks have no common safe boundary."""
    ends = encoded.select("key", (F.col("number") + 1).alias("number"), F.col("right").alias("_to"))
    seams = (encoded.select("key", "number", "left").join(ends, ["key", "number"])
             .withColumn("_at", F.array_min(F.array_intersect(F.col("left.at"), F.col("_to.at")))))

    def tokens_before(places: str):
        return F.try_element_at(F.filter(places, lambda x: x["at"] == F.col("_at")), F.lit(1))["before"]

    # Of the left chunk the tokens before the splice count; of the right one those after it.
    change = seams.select("key", (tokens_before("_to") - tokens_before("left")).alias("n"),
                          F.col("_at").isNull().alias("open"))
    whole = encoded.where("last").select("key", F.col("tokens").alias("n"), F.lit(False).alias("open"))
    return (change.unionByName(whole).groupBy("key")
            .agg(F.sum("n").alias("_n"), F.max("open").alias("_open"))
            .select("key", F.when(~F.col("_open"), F.col("_n")).alias("n_tokens")))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, chunk_chars: int = 32_768,
                 overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. The tokenizer must be byte-level with spaces kept.

    A missing text is empty: no bytes, no tokens. Repeated rows are each counted; copies of a long text
    are encoded once. Special strings in a text are what the library makes of them by default.
    """
    rows = keyed(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "tokens")
    is_long = F.char_length("text") > chunk_chars

    def count(batches):
        counter = encoders.spaced_counts(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            totals = []
            for low, high in encoders.slices(texts):
                totals += counter.count(texts[low:high])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("bigint").alias("n_bytes")
    short = rows.where(~is_long).select("doc_id", n_bytes, "text").mapInArrow(
        count, f"doc_id {id_type(rows)}, n_bytes bigint, n_tokens bigint")

    key = F.sha2("text", 256).alias("key")
    texts = rows.where(is_long).select(key, "text").dropDuplicates(["key"])
    done, waiting = [], texts
    while True:
        # By number, so that adaptive execution doesn't merge the chunks, small but costly, into few tasks.
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = _chunks(waiting, chunk_chars, overlap).repartition(parts, "key", "number")
        counted = scratch.cut(_spliced(_encoded(chunks, tokenizer)))
        done.append(counted.where("n_tokens is not null"))
        still = counted.where("n_tokens is null").select("key")
        if still.isEmpty():
            break
        waiting, overlap = texts.join(still, "key", "left_semi"), overlap * 8
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    long = (rows.where(is_long).select("doc_id", n_bytes, key).join(found, "key")
            .select("doc_id", "n_bytes", "n_tokens"))
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
