"""Message schemas, decoding and routing. Works on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVELOPE = "message_id string, timestamp timestamp, message_type string, version string, source string"
BODIES = {
    "market_update": (
        "platform string, external_id string, update_type string, old_values struct<price:double>, "
        "new_values struct<price:double>, current_market struct<title:string,volume:double>"),
    "arbitrage_opportunity": (
        "opportunity_id string, action string, market1_title string, market2_title string, "
        "expected_profit_usd double, expected_profit_percentage double, confidence_score double, "
        "risk_level string, priority_score double, detected_at timestamp, expires_at timestamp"),
    "pipeline_metrics": (
        "execution_id string, stage string, status string, input_count bigint, output_count bigint, "
        "processing_time_seconds double, success_rate double, error_count bigint"),
    "alert": "alert_id string, alert_type string, severity string, title string, description string",
}
BAD, UNKNOWN = "malformed", "unknown"


def decode(messages: DataFrame) -> DataFrame:
    """Adds the envelope and a route: a message type, unknown or malformed."""
    parsed = messages.withColumn("_e", F.from_json("value", ENVELOPE))
    kind = F.col("_e.message_type")
    route = (F.when(kind.isNull() | F.col("_e.message_id").isNull() | F.col("_e.timestamp").isNull(), BAD)
             .when(kind.isin(*BODIES), kind).otherwise(UNKNOWN))
    return parsed.select("value", "_e.message_id", "_e.timestamp", route.alias("route"))


def body(decoded: DataFrame, kind: str) -> DataFrame:
    """Typed rows of one message type."""
    return (decoded.where(F.col("route") == kind).withColumn("_b", F.from_json("value", BODIES[kind]))
            .select("message_id", "timestamp", "_b.*"))


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("route").isin(BAD, UNKNOWN)).select("value", "route")


def route_counts(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("route").agg(F.count(F.lit(1)).alias("messages"))


def deduplicated(rows: DataFrame, watermark: str) -> DataFrame:
    """Each message once; copies further apart than the watermark are not remembered."""
    return rows.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["message_id"])
