"""Streaming jobs drained from files equal their batch twins; files and sinks round-trip."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crossmarket.operators import enrich
from crossmarket.sources import derived, landing, sinks
from crossmarket.streaming import decode, jobs, metrics, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def message_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messages") / "in")
    derived.stream_messages(spark, SF).select("key", "value").repartition(3).write.json(path)
    return path


def drain(stream, tmp_path, name, mode):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return query


def test_alerts_stream_equals_batch(spark, message_dir, tmp_path):
    rows = lambda df: decode.body(decode.decode(df), "arbitrage_opportunity")
    stream = metrics.high_profit(rows(jobs.file_source(spark, message_dir)))
    drain(stream, tmp_path, "alerts", "append")
    want = metrics.high_profit(rows(spark.read.schema("key string, value string").json(message_dir)))
    assert want.count() > 0
    assert spark.table("alerts").exceptAll(want).count() == 0 and spark.table("alerts").count() == want.count()


def test_latest_markets_stream_equals_batch(spark, message_dir, tmp_path):
    rows = lambda df: decode.body(decode.decode(df), "market_update")
    pick = lambda df: metrics.latest_markets(rows(df)).select("market_key", "price", "updates")
    drain(pick(jobs.file_source(spark, message_dir)), tmp_path, "latest", "complete")
    want = pick(spark.read.schema("key string, value string").json(message_dir))
    assert spark.table("latest").exceptAll(want).count() == 0 and want.count() == spark.table("latest").count()


def test_duplicates_are_dropped(spark, message_dir, tmp_path):
    decoded = decode.decode(jobs.file_source(spark, message_dir).union(jobs.file_source(spark, message_dir)))
    drain(jobs_dedup(decoded), tmp_path, "deduped", "append")
    got = spark.table("deduped")
    assert got.count() == got.select("message_id").distinct().count() > 0


def jobs_dedup(decoded):
    return decode.deduplicated(decode.body(decoded, "alert"), "10 minutes")


def test_price_change_stream_equals_batch(spark, tmp_path):
    history = derived.price_history(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = str(tmp_path / "history")
    history.coalesce(1).write.parquet(path)
    stream = jobs.price_change_stream(spark.readStream.schema(history.schema).parquet(path))
    drain(stream, tmp_path, "changes", "append")
    want = enrich.price_changes(derived.price_history(spark, SF)).select("event_id")
    assert {r.event_id for r in spark.table("changes").collect()} == {r.event_id for r in want.collect()}


def test_handlers_get_their_types(spark, message_dir):
    seen = {}
    handlers = jobs.Handlers()
    for kind in decode.BODIES:
        handlers.add(kind, lambda df, batch_id, kind=kind: seen.__setitem__(kind, df.count()))
    handlers(spark.read.schema("key string, value string").json(message_dir), 0)
    counts = {r.route: r.messages for r in decode.route_counts(decode.decode(
        spark.read.schema("key string, value string").json(message_dir))).collect()}
    assert seen == {k: counts[k] for k in decode.BODIES}


def test_landing_files_and_sinks(spark, tmp_path):
    source = tmp_path / "landing"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"ticker": "K1", "title": "t", "yes_bid": 0.4}) + "\n{broken\n"
                                   + json.dumps({"id": "k2", "title": "u"}) + "\n" + json.dumps({"title": "no id"}) + "\n")
    records = landing.read_records(spark, str(source), "kalshi")
    envelopes = landing.envelope(records, "kalshi", landing.kalshi_key(), "2001-10-15")
    assert sorted(r.external_id for r in envelopes.collect()) == ["K1", "k2"]
    sinks.write_raw(envelopes, str(tmp_path / "raw"))
    sinks.append_new(spark, str(tmp_path / "once"), envelopes, ["external_id"])
    sinks.append_new(spark, str(tmp_path / "once"), envelopes, ["external_id"])
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2 == spark.read.parquet(str(tmp_path / "once")).count()
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"results": [{"id": "p1"}, {"id": "p2"}]}))
    (pages / "2.json").write_text(json.dumps([{"id": "p3"}]))
    found = landing.unwrap(landing.read_pages(spark, str(pages)), landing.POLYMARKET_PAYLOAD)
    assert sorted(r.id for r in found.collect()) == ["p1", "p2", "p3"]
    runs = spark.createDataFrame([(3, 0), (3, 1), (0, 2)], "processed bigint, errors bigint")
    status = sinks.run_status(F.col("processed"), F.col("errors"))
    assert [r[0] for r in runs.select(status).collect()] == ["success", "partial", "error"]


def test_open_opportunities_state_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = str(tmp_path / "in")
    derived.stream_messages(spark, SF).select("key", "value").coalesce(1).write.json(path)
    rows = lambda df: decode.body(decode.decode(df), "arbitrage_opportunity")
    drain(jobs.open_opportunities(rows(jobs.file_source(spark, path))), tmp_path, "opened", "update")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = spark.table("opened").groupBy("opportunity_id").agg(F.max_by("is_open", "timestamp").alias("o")).where("o")
    want = metrics.active_opportunities(rows(spark.read.schema("key string, value string").json(path)))
    assert {r.opportunity_id for r in last.collect()} == {r.opportunity_id for r in want.collect()}


@pytest.fixture(scope="module")
def ordered_batches(spark):
    """The opportunity messages in five parts of time."""
    rows = decode.body(decode.decode(derived.stream_messages(spark, "/root/testdata/sf0.01")), "arbitrage_opportunity")
    bounds = rows.selectExpr("percentile(unix_micros(timestamp), array(0.2, 0.4, 0.6, 0.8)) AS p").first().p
    part = sum(((F.unix_micros("timestamp") > b).cast("int") for b in bounds), F.lit(0))
    rows = rows.withColumn("_part", part).cache()
    return rows, [rows.where(F.col("_part") == i).drop("_part") for i in range(5)]


def test_open_table_over_batches_equals_batch_twin(spark, tmp_path, ordered_batches):
    rows, batches = ordered_batches
    table = tables.OpenTable(f"file://{tmp_path}/open")
    for i, batch in enumerate(batches):
        table(batch, i)
        if i in (2, 4):
            table(batch, i)  # a repeated batch changes nothing
    want = metrics.active_opportunities(rows).select("opportunity_id", "expected_profit_percentage")
    got = table.table.read(spark).select("opportunity_id", "expected_profit_percentage")
    assert want.count() > 10 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_open_table_closes_what_expired(spark, tmp_path):
    schema = ("opportunity_id string, message_id string, action string, expected_profit_percentage double, expected_profit_usd double, "
              "risk_level string, timestamp timestamp, expires_at timestamp")
    when = lambda s: dt.datetime(2001, 1, 1, 0, 0, s)
    table = tables.OpenTable(f"file://{tmp_path}/open")
    table(spark.createDataFrame([("a", "1", "detected", 0.1, 1.0, "low", when(1), when(9)),
                                 ("b", "2", "updated", 0.2, 1.0, "low", when(1), None),
                                 ("c", "3", "detected", 0.3, 1.0, "low", when(2), None)], schema), 0)
    assert {r.opportunity_id for r in table.table.read(spark).collect()} == {"a", "c"}
    table(spark.createDataFrame([("c", "4", "updated", 0.4, 1.0, "low", when(10), None)], schema), 1)
    assert [(r.opportunity_id, r.expected_profit_percentage) for r in table.table.read(spark).collect()] == [("c", 0.4)]


def test_change_log_over_batches_equals_batch_twin(spark, tmp_path):
    history = derived.price_history(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    bounds = history.selectExpr("percentile(unix_micros(timestamp), array(0.3, 0.6)) AS p").first().p
    part = sum(((F.unix_micros("timestamp") > b).cast("int") for b in bounds), F.lit(0))
    log = tables.ChangeLog(f"file://{tmp_path}/changes")
    for i in (0, 1, 1, 2):
        log(history.where(part == i), i)
    pick = lambda df: sorted(map(tuple, df.select("event_id", "price", "previous_price").collect()), key=str)
    assert pick(log.read(spark)) == pick(enrich.price_changes(history))


def test_open_opportunities_state_over_batches(spark, tmp_path, ordered_batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, batches = ordered_batches
    path = str(tmp_path / "in")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(jobs.open_opportunities(stream, "3650 days"), tmp_path, "opened_parts", "update")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = spark.table("opened_parts").groupBy("opportunity_id").agg(F.max_by("is_open", "timestamp").alias("o")).where("o")
    want = metrics.active_opportunities(rows)
    assert {r.opportunity_id for r in last.collect()} == {r.opportunity_id for r in want.collect()}
