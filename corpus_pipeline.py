"""From raw documents to packed training sequences: five stages, each on all its predecessor kept.

Stages take and give the columns of `documents`, the last one gives the places and token ids of the pieces. Every stage is
written and read again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from crossmarket.llm.common import Scratch, bounded_batches, read
from crossmarket.llm.decontamination import decontaminate
from crossmarket.llm.near_dup import near_duplicates
from crossmarket.llm.packing import packed_documents
from crossmarket.llm.pii import redact
from crossmarket.llm.rule_ensemble import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest id.

    Documents without a word are linked with nothing and stay, and so do rows without an id. Rows that repeat an id
    are told apart by a checksum of their text, so only those that are copies go; rows that repeat both are one document.
    """
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):  # ordered by the id
        key = (F.col("doc_id").cast("decimal(20,0)") * F.lit(10 ** 18).cast("decimal(19,0)")
               + F.pmod(F.xxhash64(text), F.lit(10 ** 18)).cast("decimal(19,0)")).cast("decimal(38,0)")
    else:
        key = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.md5(text))
    keyed = docs.withColumn("_key", key)
    dropped = near_duplicates(keyed, id_col="_key").where("not kept").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(dropped, "_key", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    bounded_batches(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; `n_chars` follows the text."""
    bounded_batches(spark)
    clean = redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, one row per piece, with its token ids as 32-bit integers."""
    bounded_batches(spark)
    return packed_documents(docs, with_ids=True, most_words=400_000)


STAGES = [("quality", quality), ("near_dup", near_dup), ("benchmark", benchmark), ("pii", personal_data),
          ("packing", packing)]
# The classifier, the edit distances and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each written to the shared folder and read again."""
    docs, scratch, before = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs, path = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = path
    return docs
