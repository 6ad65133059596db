"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are grown on statistics of labelled texts; every path from a root to a node is a rule, the
conjunction of its splits. A lasso logistic regression over the rules keeps few of them, and the kept rules
and weights are compiled into one Spark column expression, so scoring is native and needs no model on the
executors. Labels are the only thing learned from besides the texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch, held_out, keyed
from crossmarket.llm.quality_rules import count_chars, joined_length, let, words_of

STATISTICS = ("words", "mean_word", "distinct_share", "upper_share", "digit_share", "symbol_rate", "bar_rate",
              "bang_rate", "stop_rate", "comma_rate", "line_rate", "repeat_line_share", "long_share", "echo_share")


def statistics(text: Column) -> Column:
    """A struct of STATISTICS, all finite; of a text without words all are 0."""
    def of_words(words: Column) -> Column:
        def of_count(sizes: Column) -> Column:
            n, chars = sizes["n"], sizes["chars"]

            def per_word(count: Column) -> Column:
                return F.when(n > 0, count / n).otherwise(F.lit(0.0))

            lines = F.transform(F.filter(F.split(text, "\n"), lambda l: l != ""), lambda l: F.xxhash64(l))
            hashes = F.transform(words, lambda w: F.xxhash64(w))

            def of_hashes(h: Column) -> Column:
                echoes = F.size(F.filter(h, lambda x, i: (i > 0) & F.coalesce(x == F.get(h, i - 1), F.lit(False))))
                return F.struct(per_word(F.size(F.array_distinct(h))).alias("distinct"), per_word(echoes).alias("echo"))

            repeats = let(lines, lambda l: F.when(F.size(l) > 0, 1 - F.size(F.array_distinct(l)) / F.size(l))
                          .otherwise(F.lit(0.0)))
            shares = F.struct(
                n.cast("double").alias("words"), per_word(chars).alias("mean_word"),
                F.when(chars > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / chars).otherwise(F.lit(0.0)).alias("upper_share"),
                F.when(chars > 0, count_chars(text, "0123456789") / chars).otherwise(F.lit(0.0)).alias("digit_share"),
                per_word(count_chars(text, "#*$%&<>~^{}")).alias("symbol_rate"), per_word(count_chars(text, "|")).alias("bar_rate"),
                per_word(count_chars(text, "!")).alias("bang_rate"), per_word(count_chars(text, ".")).alias("stop_rate"),
                per_word(count_chars(text, ",")).alias("comma_rate"), per_word(count_chars(text, "\n")).alias("line_rate"),
                repeats.alias("repeat_line_share"),
                per_word(F.size(F.filter(words, lambda w: F.char_length(w) > 15))).alias("long_share"),
                let(hashes, of_hashes).alias("h"))
            return let(shares, lambda s: F.struct(*(
                (s["h"]["distinct"] if c == "distinct_share" else s["h"]["echo"] if c == "echo_share" else s[c])
                .cast("double").alias(c) for c in STATISTICS)))

        return let(F.struct(F.size(words).alias("n"), joined_length(words).alias("chars")), of_count)

    return let(words_of(text), of_words)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold), all of which must hold


@dataclass
class RuleEnsemble:
    """Rules with their weights; `score` gives the probability of label 1 as a column over the statistics."""

    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, stats: Column) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            margin = margin + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def score_text(self, text: Column) -> Column:
        return let(statistics(F.coalesce(text, F.lit(""))), self.score)


def _holds(rule: Rule, stats: Column) -> Column:
    condition = F.lit(True)
    for number, at_most, threshold in rule:
        value = stats[STATISTICS[number]]
        condition = condition & (value <= threshold if at_most else value > threshold)
    return condition


def _paths(node, so_far: Rule, found: dict[Rule, None]) -> None:
    """All path prefixes below a tree node of the fitted forest; splits of a path that repeat are merged."""
    if so_far:
        found.setdefault(so_far)
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    number, threshold = split.featureIndex(), split.threshold()
    for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
        kept = [s for s in so_far if s[:2] != (number, at_most)]
        _paths(child, tuple(sorted([*kept, (number, at_most, threshold)])), found)


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """`labelled` has `stats` (see `statistics`) and `label` (0 or 1). With one label or none there is nothing to
    separate: the score is then the smoothed share of label 1, 0.5 without rows."""
    counts = {int(r["label"]): r["count"] for r in labelled.groupBy("label").count().collect()}
    zeros, ones = counts.get(0, 0), counts.get(1, 0)
    prior = math.log((ones + 0.5) / (zeros + 0.5))
    if not zeros or not ones:
        return RuleEnsemble(prior)
    flat = labelled.select("label", *(F.col(f"stats.{c}").alias(c) for c in STATISTICS))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(flat)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
                                    maxBins=64).fit(vectors)
    found: dict[Rule, None] = {}
    for tree in forest.trees:
        _paths(tree._java_obj.rootNode(), (), found)
    rules = sorted(found)
    if not rules:
        return RuleEnsemble(prior)
    held = labelled.select("label", *(
        F.when(_holds(rule, F.col("stats")), 1.0).otherwise(0.0).alias(f"rule{i}") for i, rule in enumerate(rules)))
    inputs = VectorAssembler(inputCols=[f"rule{i}" for i in range(len(rules))], outputCol="features").transform(held)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(
        inputs.select("label", "features"))
    weights = {rule: float(w) for rule, w in zip(rules, lasso.coefficients) if w}
    return RuleEnsemble(float(lasso.intercept), weights)


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label per id: the smallest where an id has several; rows without an id or a label are left out."""
    return (labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
            .groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.min(F.col(f"`{label_col}`").cast("int")).alias("label")))


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> RuleEnsemble:
    """An ensemble from the rows of (doc_id, held_out, stats) that are not held out and have a label."""
    known = (measured.where(~F.col("held_out")).join(_labels(labels, id_col, label_col), "doc_id")
             .select("label", "stats"))
    return fit(known)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Learns from labelled rows whose id's checksum is not 0 modulo `folds`; all of them, on Spark. Missing and
    empty texts are scored like any other, by statistics that are all 0. Repeated rows each count and are
    each scored; a row without an id has no label. An empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)
    measured = Scratch(docs.sparkSession, "rules").cut(rows.select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), statistics(F.col("text")).alias("stats")))
    ensemble = train(measured, labels, label_col=label_col)
    score = ensemble.score(F.col("stats"))
    return (measured.select("doc_id", "held_out", score.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows, all columns as they are, that score at least the threshold; rows are dropped where they lie."""
    known = _labels(labels, "doc_id", label_col)
    rows = keyed(docs, id_col, text_col)
    measured = Scratch(docs.sparkSession, "rules").cut(
        rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), statistics(F.col("text")).alias("stats"))
        .where(~F.col("held_out")).join(known, "doc_id"))
    ensemble = fit(measured.select("label", "stats"))
    return docs.where(ensemble.score_text(F.col(f"`{text_col}`")) >= threshold)
