"""Streaming jobs: sources, sinks, stateful operators and handler routing."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter

from crossmarket.config import StreamConfig
from crossmarket.sources.checkpoints import checkpoint_root
from crossmarket.streaming import decode

CFG = StreamConfig()
Handler = Callable[[DataFrame, int], None]


def kafka_source(spark: SparkSession, servers: str, cfg: StreamConfig = CFG, starting: str = "latest") -> DataFrame:
    """The four topics as (key, value) text, with a bounded batch size."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(cfg.topics.values())).option("startingOffsets", starting)
            .option("maxOffsetsPerTrigger", cfg.max_offsets).load()
            .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))


def file_source(spark: SparkSession, path: str, fmt: str = "json", schema: str = "key string, value string",
                files_per_trigger: int | None = None) -> DataFrame:
    """The same rows from files, for replays and tests."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


MESSAGE_KEYS = {"arbitrage_opportunity": "opportunity_id",
                "pipeline_metrics": "execution_id", "alert": "alert_id"}


def keyed_messages(rows: DataFrame, kind: str, cfg: StreamConfig = CFG) -> DataFrame:
    """(key, value, topic) of one message type: the key decides the partition."""
    key = F.concat_ws(":", "platform", "external_id") if kind == "market_update" else F.col(MESSAGE_KEYS[kind])
    value = F.to_json(F.struct(F.lit(kind).alias("message_type"), F.lit("1.0").alias("version"), *rows.columns))
    return rows.select(key.alias("key"), value.alias("value"), F.lit(cfg.topics[kind]).alias("topic"))


def kafka_sink(messages: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    return (messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("kafka.compression.type", "gzip").option("kafka.acks", "all")
            .option("checkpointLocation", checkpoint))


def start(writer: DataStreamWriter, cfg: StreamConfig = CFG, once: bool = False):
    """Runs continuously on the trigger interval, or drains what is there."""
    trigger = {"availableNow": True} if once else {"processingTime": cfg.trigger}
    return writer.trigger(**trigger).start()


class Handlers:
    """Callables per message type; each gets the typed rows of a micro-batch."""

    def __init__(self) -> None:
        self._by_kind: dict[str, list[Handler]] = {kind: [] for kind in decode.BODIES}
        self._rejected: list[Handler] = []

    def add_rejected(self, handler: Handler) -> None:
        """Called with the messages no handler can take: value and route."""
        self._rejected.append(handler)

    def add(self, kind: str, handler: Handler) -> None:
        self._by_kind[kind].append(handler)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Decodes once, then hands every type's rows to its handlers."""
        decoded = decode.decode(batch).persist()
        try:
            for kind, handlers in self._by_kind.items():
                for handler in handlers:
                    handler(decode.body(decoded, kind), batch_id)
            for handler in self._rejected:
                handler(decode.quarantine(decoded), batch_id)
        finally:
            decoded.unpersist()


def run_handlers(messages: DataFrame, handlers: Handlers, name: str) -> DataStreamWriter:
    root = checkpoint_root(messages.sparkSession)
    return messages.writeStream.foreachBatch(handlers).option("checkpointLocation", f"{root}/{name}")


OPEN_STATE = "timestamp timestamp, expected_profit_percentage double, expires_at timestamp"
OPEN_OUTPUT = "opportunity_id string, is_open boolean, expected_profit_percentage double, timestamp timestamp"


class OpenOpportunities(StatefulProcessor):
    """Open opportunities per id: detected opens, updated replaces while open, ends close.

    A timer at expires_at closes what nobody closes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", OPEN_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["timestamp", "message_id"])
        action = frame["action"].to_numpy()
        place = np.arange(len(frame))
        last_end = int(place[np.isin(action, ("expired", "executed"))].max(initial=-1))
        visible = np.isin(action, ("detected", "updated"))
        if last_end >= 0 or not self.state.exists():  # what was open before is closed, or nothing was
            opened = place[(action == "detected") & (place > last_end)]
            visible &= place >= (opened[0] if len(opened) else len(frame))
            if not len(opened) and self.state.exists():
                self.state.clear()
        if visible.any():
            newest = frame.iloc[int(place[visible].max())]
            expires = None if pd.isna(newest["expires_at"]) else newest["expires_at"]
            self.state.update((newest["timestamp"], newest["expected_profit_percentage"], expires))
            if expires is not None:
                self.handle.registerTimer(int(expires.timestamp() * 1000))
        yield self._snapshot(key, frame["timestamp"].iloc[-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        if held and held[2] is not None and held[2].timestamp() * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._snapshot(key, held[2])

    def _snapshot(self, key, when) -> pd.DataFrame:
        held = self.state.get() if self.state.exists() else None
        return pd.DataFrame({"opportunity_id": [key[0]], "is_open": [held is not None],
                             "expected_profit_percentage": [held[1] if held else None], "timestamp": [when]})

    def close(self) -> None:
        pass


def open_opportunities(opportunities: DataFrame, watermark: str = CFG.watermark) -> DataFrame:
    """Stateful stream of open/closed transitions (needs the RocksDB state store)."""
    return (opportunities.withWatermark("timestamp", watermark).groupBy("opportunity_id")
            .transformWithStateInPandas(OpenOpportunities(), outputStructType=OPEN_OUTPUT,
                                        outputMode="Update", timeMode="EventTime"))


def price_change_stream(observations: DataFrame) -> DataFrame:
    """Observations whose price differs from the last one of their series."""
    def changes(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["timestamp", "event_id"])
        before = rows["price"].shift(1)
        before.iloc[0] = last if last is not None else float("nan")
        kept = rows[before.isna() | (rows["price"] != before)]
        state.update((float(rows["price"].iloc[-1]),))
        yield pd.DataFrame({"market_id": key[0], "outcome": key[1], "price": kept["price"].values,
                            "event_id": kept["event_id"].values, "timestamp": kept["timestamp"].values})

    return observations.groupBy("market_id", "outcome").applyInPandasWithState(
        changes, "market_id string, outcome string, price double, event_id bigint, timestamp timestamp",
        "price double", "append", "NoTimeout")


class StreamHealth(StreamingQueryListener):
    """Rows, failures and the health verdict of the running queries."""

    def __init__(self, cfg: StreamConfig = CFG) -> None:
        self.cfg, self.rows, self.batches, self.failures, self.ended = cfg, 0, 0, 0, 0
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self.batches += 1
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.failures += int(event.exception is not None)
            self.ended += 1

    def wait(self, queries: int, seconds: float = 60.0) -> None:
        """Until the ends of so many queries have been reported; reports come a little after the queries end."""
        until = time.monotonic() + seconds
        while self.ended < queries and time.monotonic() < until:
            time.sleep(0.05)

    def health(self, bad_messages: int = 0) -> dict[str, object]:
        with self._lock:
            rate = bad_messages / self.rows if self.rows else 0.0
            degraded = rate > self.cfg.error_rate or self.failures > 0
            return {"rows": self.rows, "batches": self.batches, "failures": self.failures,
                    "error_rate": rate, "status": "degraded" if degraded else "healthy"}
