"""One query per operator: production parameters over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.llm import collocations, hard_negatives, preference_format, quality_rules, warc
from crossmarket.llm.common import read


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.decontamination import contaminated
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.class_lm import score_texts
    return score_texts(read(spark, sf_dir, "documents"))


def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.language_id import identify
    return identify(read(spark, sf_dir, "documents"))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.near_dup import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.pii import find_pii
    return find_pii(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.token_count import count_tokens
    return count_tokens(read(spark, sf_dir, "documents"))


def op7_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.quality_rules import clean_lines
    return clean_lines(read(spark, sf_dir, "documents")).drop("cleaned")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.packing import packed_documents
    return packed_documents(read(spark, sf_dir, "documents"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.rule_ensemble import score_quality
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossmarket.llm.preference_format import derived_pairs, format_pairs
    return format_pairs(derived_pairs(read(spark, sf_dir, "conversations")))


def op11_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages"))


def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has its label moved on by one first, so that classes overlap; every hundredth is an anchor."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_cgk_decontamination, op2_class_ngrams, op3_kneser_ney_language, op4_minhash_near_dup, op5_anchored_pii,
    op6_token_counts, op7_line_first_rules, op8_best_fit_packing, op9_rule_ensemble,
    op10_preference_format, op11_trie_collocations, op12_warc_chunks, op13_strassen_negatives)}
ORACLES = {"op7_line_first_rules": quality_rules.ORACLE_SQL, "op10_preference_format": preference_format.ORACLE_SQL,
           "op11_trie_collocations": collocations.ORACLE_SQL, "op12_warc_chunks": warc.ORACLE_SQL, "op13_strassen_negatives": hard_negatives.ORACLE_SQL}
