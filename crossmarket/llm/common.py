"""What the operators share: their narrow input, shared-folder tables, fixed splits of the rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.sources.checkpoints import checkpoint_root
from crossmarket.sources.workers import reachable  # noqa: F401

# The white space between words, as the body of a character class.
SPACE = r"\x20\x09-\x0D"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of at most about so many bytes, unless the session says otherwise; Spark alone bounds only their rows."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, size)


_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None] = lambda: None) -> None:
    """Said by a Python worker that starts on an operator's rows: what it kept for other operators is forgotten.

    Workers live on from stage to stage, so tables of words kept for one would stand beside those of the next.
    """
    others = [o for o in _kept if o != operator]
    for other in others:
        _kept.pop(other)()
    _kept[operator] = forget
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a missing text is an empty one.

    Operators work on these two columns alone, so other columns, whatever their names, never clash.
    """
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def held_out(column: Column, folds: int) -> Column:
    """True for one row in `folds`, by the checksum of the id as text; false for a missing id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ROWS_UNSEEN = 3  # rows of megabytes that may be written before their bytes are looked at again


class Scratch:
    """Tables in the folder all executors share: lineage is cut there, and loops drop what they no longer need.

    A table is written by ordinary Spark tasks and committed as a whole, so a lost executor costs a
    repeated task and never a missing file.
    """

    def __init__(self, spark: SparkSession, name: str):
        reachable(spark)
        self.spark, self.base = spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, row_group: int | None = None) -> tuple[DataFrame, str]:
        """The table and its path. `row_group` bounds the bytes that a task holds of it, for rows of megabytes each.

        A writer holds a row group and a reader a batch of rows of one, and Parquet looks at the bytes only after 100 rows.
        """
        self.count += 1
        path = f"{self.base}/{self.count}"
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        if row_group:
            writer = writer.options(**{"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1,
                                       "parquet.page.size.row.check.max": 1 + ROWS_UNSEEN})
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str | None) -> None:
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dense_numbers(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with `number`, 0 to n - 1 without gaps, in no stated order.

    They are written once with Spark's id per task and row, so the numbers stay the same however often the result is
    read. The driver sees one count per task that wrote.
    """
    table = scratch.cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    total, starts = 0, []
    for at, many in sorted(map(tuple, table.groupBy(task.alias("_task")).count().collect())):
        starts.append((at, total))
        total += many
    starts = rows.sparkSession.createDataFrame(starts, "_task bigint, _start bigint")
    return (table.join(F.broadcast(starts), task == F.col("_task"))
            .withColumn("number", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_at", "_task", "_start"))


def shared_lookup(rows: DataFrame, table: DataFrame, on: list[str], scratch: Scratch, share: int = 1000) -> DataFrame:
    """Inner join with a table of unique keys, however many rows share a key.

    Keys of more than 1 / `share` of the rows are fewer than `share`, so their part of the table is broadcast. Of the
    other keys none can make a partition large. The rows are written first, since they are read three times.
    """
    rows = scratch.cut(rows)
    total = rows.count()
    hot = F.broadcast(rows.groupBy(*on).count().where(F.col("count") * share > total).select(*on))
    often = F.broadcast(table.join(hot, on, "left_semi"))
    return rows.join(often, on).unionByName(rows.join(hot, on, "left_anti").join(table, on))
