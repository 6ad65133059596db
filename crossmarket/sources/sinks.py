"""Writers. All are plain partitioned Parquet; appends are safe to repeat per batch id."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.operators import tables


def write_raw(envelopes: DataFrame, path: str) -> None:
    """Appends raw envelopes with an id per row."""
    envelopes.withColumn("id", F.expr("uuid()")).write.mode("append").partitionBy("platform").parquet(path)


def normalized_rows(df: DataFrame) -> DataFrame:
    """Normalized markets with their nested parts as JSON text."""
    return df.withColumn("outcomes", F.to_json("outcomes")).withColumn(
        "id", F.concat_ws("-", "platform", "external_id"))


def write_normalized(df: DataFrame, path: str) -> None:
    normalized_rows(df).write.mode("append").partitionBy("platform").parquet(path)


def opportunity_rows(df: DataFrame) -> DataFrame:
    """Opportunities flattened to the stored columns, nested parts as JSON text."""
    risk = F.struct("liquidity_risk", "timing_risk", "execution_risk", "correlation_risk", "risk_score")
    metrics = F.struct("expected_profit_usd", "expected_profit_percentage", "roi_percentage",
                       "success_probability", "execution_minutes")
    return df.select(
        "opportunity_id", F.col("kalshi_id").alias("market1_id"), F.col("polymarket_id").alias("market2_id"),
        "arbitrage_type", F.col("expected_profit_usd").cast("decimal(18,4)").alias("expected_profit_usd"),
        "expected_profit_percentage", "confidence_score", "risk_level", "risk_score", "priority_score",
        F.to_json("strategy").alias("strategy"), F.to_json("transaction_costs").alias("transaction_costs"),
        F.to_json(risk).alias("risk_assessment"), F.to_json(metrics).alias("metrics"), "detected_at",
        "expires_at", "status")


def write_opportunities(df: DataFrame, path: str) -> None:
    opportunity_rows(df).write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or an empty one if the path does not exist; any other failure is raised."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else spark.createDataFrame([], like.schema)


def swap_in(spark: SparkSession, root: str, next_table: DataFrame) -> str:
    """Writes the next version beside the current one; the returned path is what to read now.

    A table is never overwritten while it is being read: readers keep the old version until
    they pick up the new path.
    """
    path = f"{root}/version={uuid.uuid4().hex}"
    next_table.write.mode("errorifexists").parquet(path)
    return path


def append_new(spark: SparkSession, path: str, source: DataFrame, keys: list[str]) -> None:
    """Insert-or-ignore into a Parquet table."""
    target = read_or_empty(spark, path, source)
    tables.insert_or_ignore(target, source, keys).write.mode("append").parquet(path)


def run_status(processed: Column, errors: Column) -> Column:
    """success without errors, partial with some, error when nothing went through."""
    return F.when(errors == 0, "success").when(processed > 0, "partial").otherwise("error")


RUN_LOG = ("run_id string, kind string, platform string, status string, processed bigint, errors bigint, "
           "started_at timestamp, finished_at timestamp")


def append_run_log(spark: SparkSession, path: str, row: tuple) -> None:
    """One row per run; `row` follows RUN_LOG without the status, which follows from the counts."""
    schema = RUN_LOG.replace("status string, ", "")
    log = spark.createDataFrame([row], schema).withColumn("status", run_status(F.col("processed"), F.col("errors")))
    log.select(*(c.split()[0] for c in RUN_LOG.split(", "))).write.mode("append").parquet(path)


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as one DataFrame."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in named.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """First n rows, or the n with the smallest hash of seed and row: a random choice that repeats.

    The n best of every task are kept before anything is sent, so the table is never sorted.
    """
    if seed is None:
        return df.limit(n)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in df.columns]))
    return df.orderBy(draw).limit(n)
