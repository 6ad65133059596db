"""Learned pair worthiness with MLlib: training, metrics, scoring and retraining."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.config import ModelConfig
from crossmarket.operators.ranks import rank_auc
from crossmarket.operators.scoring import FEATURES, explanation, heuristic_score
from crossmarket.sources.checkpoints import cut


def labelled(scored: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Feature columns as doubles plus label = confidently equivalent."""
    return scored.select(
        "kalshi_id", "polymarket_id", *[F.col(c).cast("double").alias(c) for c in FEATURES],
        (F.col("confidence_score") >= cfg.positive_confidence).cast("double").alias("label"))


def is_held_out(cfg: ModelConfig = ModelConfig()) -> Column:
    """By a hash of the pair: the same on every run and cluster."""
    return F.pmod(F.xxhash64("kalshi_id", "polymarket_id", F.lit(cfg.seed)), F.lit(1000)) < int(cfg.test_share * 1000)


def split(df: DataFrame, cfg: ModelConfig = ModelConfig()) -> tuple[DataFrame, DataFrame]:
    """Train and test rows."""
    return df.where(~is_held_out(cfg)), df.where(is_held_out(cfg))


def dealt(rows: DataFrame) -> DataFrame:
    """The rows, written once in as many even files as there are shuffle partitions.

    Fitting reads them once per level of the trees, in as many tasks as there are files. They are few bytes a row, so
    adaptive execution alone would leave them in a few files, whatever the cost of a row.
    """
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartition(many, "kalshi_id", "polymarket_id"))


def estimator(cfg: ModelConfig = ModelConfig()) -> Pipeline:
    if cfg.kind == "gradient_boosting":
        classifier = GBTClassifier(maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=cfg.step, seed=cfg.seed,
                                   featuresCol="features", labelCol="label")
    elif cfg.kind == "random_forest":
        classifier = RandomForestClassifier(numTrees=cfg.trees, maxDepth=cfg.depth, seed=cfg.seed,
                                            featuresCol="features", labelCol="label")
    else:
        raise ValueError(f"unknown model kind: {cfg.kind}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features"),
                            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
                            classifier])


def train(training: DataFrame, cfg: ModelConfig = ModelConfig()) -> PipelineModel | None:
    """Fits the pipeline; None if there are fewer than `cfg.min_rows` rows or only one label to learn from."""
    counts = training.groupBy("label").count().collect()  # two rows at most
    if sum(r["count"] for r in counts) < cfg.min_rows or len(counts) < 2:
        return None
    return estimator(cfg).fit(training)


def predict(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """P(equivalent) and confidence per pair; without a model the heuristic score stands in."""
    if model is None:
        scored = features.withColumn("worthiness", heuristic_score(F.col("category_match").cast("boolean"))).withColumn(
            "prediction", (F.col("worthiness") > 0.5).cast("double"))
    else:
        scored = model.transform(features).withColumn("worthiness", vector_to_array("probability")[1])
    return scored.withColumn("confidence_prediction", F.least(F.lit(0.9), F.col("worthiness") + 0.1))


def explained(predictions: DataFrame) -> DataFrame:
    """Adds the explanation text; flags must be booleans again after vectorization."""
    flags = predictions.withColumns({c: F.col(c).cast("boolean") for c in ("category_match", "both_closing_soon")})
    return flags.withColumn("explanation", explanation(F.col("worthiness")))


def metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from a table of label and prediction, in one pass."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    counts = predictions.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                             F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("tp", "fp", "fn", "tn", rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                         rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
                         rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(predictions: DataFrame) -> float | None:
    """Of the scores, by rank sums; None if a class is absent."""
    return rank_auc(predictions).first()["roc_auc"]


def cross_validated(training: DataFrame, cfg: ModelConfig = ModelConfig()) -> float | None:
    """Mean accuracy over the folds, which a hash of the pair deals; only the models of the folds are fitted.

    A fold whose other rows are too few or of one label has no model and does not count; None if none has.
    """
    fold = F.pmod(F.xxhash64("kalshi_id", "polymarket_id", F.lit(cfg.seed + 1)), F.lit(cfg.folds))
    found = []
    for k in range(cfg.folds):
        held = training.where(fold == k)
        fitted = train(training.where(fold != k), replace(cfg, min_rows=1))
        if fitted is not None and not held.isEmpty():
            found.append(metrics(fitted.transform(held)).first()["accuracy"])
    return sum(found) / len(found) if found else None


def importances(model: PipelineModel) -> dict[str, float]:
    return dict(zip(FEATURES, (float(v) for v in model.stages[-1].featureImportances.toArray())))


def quality(fitted: PipelineModel | None, train_rows: DataFrame, test_rows: DataFrame,
            cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """(measure, value): counts, held-out metrics and AUC, cross-validated accuracy, importances, and whether retraining on
    the same rows replaces the model. What needs a model is null where none could be fitted.
    """
    held = cut(predict(fitted, test_rows).select("label", "prediction", "worthiness"))  # predicted once, read by every measure
    tested = metrics(held).first().asDict()
    found: dict[str, float | None] = {"train_rows": train_rows.count(), "test_rows": test_rows.count(),
                                      "fitted": float(fitted is not None)}
    names = ("accuracy", "precision", "recall", "f1")
    found |= {f"held_out_{n}": None if fitted is None else tested[n] for n in names}
    found["held_out_roc_auc"] = None if fitted is None else roc_auc(held)
    found["cross_validated_accuracy"] = None if fitted is None else cross_validated(train_rows, cfg)
    weights = dict.fromkeys(FEATURES) if fitted is None else importances(fitted)
    found |= {f"importance_{n}": v for n, v in weights.items()}
    found["replaced_by_retraining"] = float(retrain(fitted, train_rows.unionByName(test_rows), cfg)[1])
    rows = [(n, None if v is None else float(v)) for n, v in found.items()]
    return train_rows.sparkSession.createDataFrame(rows, "measure string, value double")


def bucket_success(evaluated: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Measured success rate per bucket, usable as the history of the feature step."""
    return evaluated.groupBy("bucket").agg(
        F.avg((F.col("confidence_score") >= threshold).cast("double")).alias("success_rate"),
        F.count(F.lit(1)).alias("evaluations"))


def retrain(current: PipelineModel | None, recent: DataFrame, cfg: ModelConfig = ModelConfig()):
    """(model to deploy, was replaced): the new model only if it is more accurate on held-out rows."""
    train_rows, test_rows = split(recent, cfg)
    fresh = train(train_rows, cfg)
    if fresh is None:
        return current, False
    accuracy = lambda m: metrics(m.transform(test_rows)).first()["accuracy"]
    if current is not None and accuracy(fresh) <= accuracy(current):
        return current, False
    return fresh, True
