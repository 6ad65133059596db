"""Stream state as tables: every micro-batch is reduced per key by Spark, then merged into the table in one step.

Reducing happens before the shuffle, so a busy key sends one row per task, and no Python runs per row or key. A batch
writes the version named after it, so a batch that is run again replaces its own version only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.operators import enrich
from crossmarket.sources.checkpoints import release


class VersionedTable:
    """One folder per batch; a reader takes the newest, a batch starts from the newest before it."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _versions(self, spark: SparkSession) -> list[int]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        known = [v for v in self._versions(spark) if before is None or v < before]
        return spark.read.parquet(f"{self.root}/batch={known[-1]}") if known else None

    def write(self, df: DataFrame, batch_id: int, keep: int = 3) -> None:
        """Writes a version; of the older ones the last few stay, for readers and repeated batches."""
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        for old in self._versions(df.sparkSession)[:-keep]:
            release(df.sparkSession, f"{self.root}/batch={old}")


STATE = ("expected_profit_percentage", "expected_profit_usd", "risk_level", "timestamp", "expires_at")


class OpenTable:
    """Open opportunities: detected opens, updated replaces while open, expired and executed close, time closes what has expired.

    Of a batch only three maxima per opportunity matter: the last detection, the last end, the newest visible state.
    """

    def __init__(self, root: str) -> None:
        self.table = VersionedTable(root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.struct("timestamp", "message_id")
        action = F.col("action")
        visible = action.isin("detected", "updated")
        fresh = batch.groupBy("opportunity_id").agg(
            F.max(F.when(action == "detected", order)).alias("_in"),
            F.max(F.when(action.isin("expired", "executed"), order)).alias("_out"),
            F.max_by(F.struct(*STATE), F.when(visible, order)).alias("_new"), F.max("timestamp").alias("_seen"))
        known = self.table.read(spark, batch_id)
        if known is None:
            known = spark.createDataFrame([], "opportunity_id string, " + ", ".join(
                f"{c} {batch.schema[c].dataType.simpleString()}" for c in STATE) + ", clock timestamp")
        held = known.select("opportunity_id", F.struct(*STATE).alias("_old"), "clock")
        merged = held.join(fresh, "opportunity_id", "full")
        opened = F.col("_in").isNotNull() & (F.col("_out").isNull() | (F.col("_in") > F.col("_out")))
        stays = F.col("_in").isNull() & F.col("_out").isNull() & F.col("_old").isNotNull()
        now = fresh.agg(F.max("_seen").alias("_n")).unionByName(known.agg(F.max("clock").alias("_n"))).agg(F.max("_n").alias("_now"))
        rows = merged.where(opened | stays).select("opportunity_id", F.coalesce("_new", "_old").alias("s")).select("opportunity_id", "s.*")
        rows = rows.join(F.broadcast(now)).where(F.col("expires_at").isNull() | (F.col("expires_at") > F.col("_now")))
        self.table.write(rows.withColumnRenamed("_now", "clock"), batch_id)


class ChangeLog:
    """Price observations that differ from the last one of their series, appended per batch; the state is one row per series."""

    def __init__(self, root: str) -> None:
        self.last, self.log = VersionedTable(f"{root}/last"), f"{root}/changes"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        columns = ["event_id", "market_id", "outcome", "price", "timestamp"]
        known = self.last.read(batch.sparkSession, batch_id)
        rows = batch.select(*columns, F.lit(False).alias("_known"))
        if known is not None:
            rows = rows.unionByName(known.select(*columns, F.lit(True).alias("_known")))
        changes = enrich.price_changes(rows).where("NOT _known").select(*columns, "previous_price")
        changes.write.mode("overwrite").parquet(f"{self.log}/batch={batch_id}")
        order = F.struct("timestamp", "event_id")
        newest = rows.groupBy("market_id", "outcome").agg(F.max_by(F.struct("event_id", "price", "timestamp"), order).alias("s"))
        self.last.write(newest.select("market_id", "outcome", "s.*"), batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.log).drop("batch")
