"""Registered queries over what runs wrote: the run log of an observed batch run, and the health of a drained stream."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmarket.operators import arbitrage, normalize
from crossmarket.plans import evaluations, funnel, listings
from crossmarket.plans.registry import query
from crossmarket.sources import derived, landing, sinks
from crossmarket.sources.checkpoints import checkpoint_root, cut
from crossmarket.sources.derived import AS_OF
from crossmarket.streaming import decode, jobs


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def logged(spark: SparkSession, log: str, kind: str, platform: str, done: tuple, rejected: tuple) -> None:
    """Writes good and rejected rows, each a (rows, writer), counts both while they are written, and appends the run's row."""
    started, seen = dt.datetime.now(dt.timezone.utc), []
    for name, (df, write) in (("done", done), ("rejected", rejected)):
        counted, observation = funnel.observed(df, f"{kind}-{platform}-{name}-{uuid.uuid4().hex}")
        write(counted)
        seen.append(observation.get["rows"])
    sinks.append_run_log(spark, log, (uuid.uuid4().hex, kind, platform, *seen, started, dt.datetime.now(dt.timezone.utc)))


@query("k28_run_log", """
    SELECT 'normalize' AS kind, platform, CASE WHEN errors = 0 THEN 'success' WHEN processed > 0 THEN 'partial' ELSE 'error' END AS status,
           processed, errors
    FROM (SELECT CASE WHEN external_id LIKE '%7' THEN 'manifold' ELSE platform END AS platform,
                 count(*) FILTER (external_id NOT LIKE '%7' AND external_id NOT LIKE '%5') AS processed,
                 count(*) FILTER (external_id LIKE '%7' OR external_id LIKE '%5') AS errors FROM mixed GROUP BY 1)
    UNION ALL SELECT 'detect', 'all', 'success', count(*), 0 FROM found""", views={"mixed": listings.MIXED, **evaluations.ECON})
def _(spark, root):
    """Normalization per platform and detection, written to tables; the log has what was counted on the way."""
    out = fresh_folder(spark, "run")
    log = f"{out}/log"
    mixed = cut(listings.mixed_envelopes(spark, root).select("id", "platform", "raw_data"))
    for platform in ("kalshi", "polymarket", "manifold"):
        done, rejected = normalize.dispatch(mixed.where(F.col("platform") == platform), AS_OF, landing.PAYLOADS)
        logged(spark, log, "normalize", platform, (done, lambda df: sinks.write_normalized(df, f"{out}/normalized")),
               (rejected, lambda df: df.write.mode("append").parquet(f"{out}/rejected")))
    found = arbitrage.detect(evaluations.evaluated(spark, root), AS_OF)
    logged(spark, log, "detect", "all", (found, lambda df: sinks.write_opportunities(df, f"{out}/opportunities")),
           (found.limit(0), lambda df: df.write.format("noop").mode("overwrite").save()))
    return spark.read.parquet(log).select("kind", "platform", "status", "processed", "errors")


@query("l11_stream_health", """
    SELECT measure, value FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (kind IN ('malformed', 'user_joined'))::DOUBLE AS bad FROM messages),
      LATERAL (SELECT unnest(['rows', 'bad_messages', 'error_rate', 'failures', 'degraded']) AS measure,
                      unnest([n, bad, bad / n, 0, CASE WHEN bad / n > 0.1 THEN 1 ELSE 0 END]) AS value)
    UNION ALL SELECT 'written_' || kind, count(*)::DOUBLE FROM messages WHERE kind NOT IN ('malformed', 'user_joined') GROUP BY kind""",
       r="value")
def _(spark, root):
    """The message stream drained through handlers that write a table per type; measures by a listener and from the tables."""
    out = fresh_folder(spark, "stream")
    derived.stream_messages(spark, root).select("key", "value").write.parquet(f"{out}/in")

    def table(name: str) -> jobs.Handler:
        return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    handlers, health = jobs.Handlers(), jobs.StreamHealth()
    for kind in decode.BODIES:
        handlers.add(kind, table(kind))
    handlers.add_rejected(table("rejected"))
    spark.streams.addListener(health)
    try:
        stream = jobs.file_source(spark, f"{out}/in", "parquet")
        jobs.start(jobs.run_handlers(stream, handlers, f"health-{uuid.uuid4().hex}"), once=True).awaitTermination()
        health.wait(1)
    finally:
        spark.streams.removeListener(health)
    bad = spark.read.parquet(f"{out}/rejected").count()
    report = health.health(bad)
    rows = [("rows", report["rows"]), ("bad_messages", bad), ("error_rate", report["error_rate"]),
            ("failures", report["failures"]), ("degraded", report["status"] == "degraded")]
    measured = spark.createDataFrame([(m, float(v)) for m, v in rows], "measure string, value double")
    for kind in decode.BODIES:
        written = spark.read.parquet(f"{out}/{kind}").agg(F.lit(f"written_{kind}").alias("measure"),
                                                          F.count(F.lit(1)).cast("double").alias("value"))
        measured = measured.unionByName(written.where("value > 0"))
    return measured
