"""Where lineage is cut: the shared folder the cluster names, never a local one on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _local_root(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        return _local_root(spark.sparkContext.applicationId)
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once as a table in the shared folder and read back.

    For results that are expensive to derive and read more than once downstream: the derivation
    runs once, survives lost executors, and readers fetch only the columns they use.
    """
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """`cut` with the path of the table, for callers that `release` it themselves."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
