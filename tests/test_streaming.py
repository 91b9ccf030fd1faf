"""Stream replay equals batch, also across a restart; late rows are dropped and counted."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellhealth.model import scoring, training
from cellhealth.operators import monitor, sampling
from cellhealth.operators.features import feature_rows, latest_features
from cellhealth.operators.windows import cell_windows, flat_windows
from cellhealth.plans import oracle, registry, tables
from cellhealth.schemas import FEATURES, FLAT_WINDOW_SCHEMA, TELEMETRY_SCHEMA
from cellhealth.session import tables_root
from cellhealth.sources.tables import DayTable, OnlineTable
from cellhealth.sources.telemetry import accepted, decode, file_stream, keyed_json
from cellhealth.streaming import queries
from cellhealth.streaming.samples import sampled_windows
from cellhealth.streaming.timers import timed_windows
from conftest import MEDIUM, SMALL, event
from oracle_check import TABLES, connect, difference

DAY = 86_400


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Telemetry on disk as three files in event-time order, and the paths of the files."""
    rows = tables.telemetry(spark, SMALL).select(*TELEMETRY_SCHEMA.names)
    root = tmp_path_factory.mktemp("events")
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        path = f"{root}/{low}"
        rows.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(path)
        parts.append(path)
        time.sleep(0.05)
    return rows, parts


def replay(spark, parts, target):
    """Copy files into a source directory one by one, so that they arrive in order."""
    for part in parts:
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(target)
        time.sleep(1.1)


def stream(spark, path):
    return spark.readStream.schema(TELEMETRY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def closed(batch, until="2024-01-30"):
    """Batch windows without the last day's, which no later event closes."""
    return batch.filter(F.col("window_end") <= until)


def same(left, right):
    assert left.columns == right.columns
    assert left.count() > 0
    assert left.exceptAll(right).count() == 0
    assert right.exceptAll(left).count() == 0


def counted(spark, rows, path):
    """Late rows of a stream run to its end, and the query."""
    listener = queries.LateRows()
    spark.streams.addListener(listener)
    query = queries.append_to_table(rows, f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    for _ in range(100):  # progress is reported a moment later
        if listener.last_batch(query) == query.lastProgress["batchId"]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    return listener.count(query), query


def test_ordered_replay_equals_batch(spark, events, tmp_path):
    rows, parts = events
    replay(spark, parts, f"{tmp_path}/in")
    out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
    late, query = counted(spark, out, tmp_path)
    assert late == 0 and query.exception() is None
    same(spark.read.parquet(f"{tmp_path}/out"), closed(flat_windows(rows, DAY)))


def test_sliding_replay_equals_batch(spark, events, tmp_path):
    rows, parts = events
    replay(spark, parts, f"{tmp_path}/in")
    out = queries.window_stream(stream(spark, f"{tmp_path}/in"), 3 * DAY, DAY, "1 hour", flat=True)
    queries.append_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out"), closed(flat_windows(rows, 3 * DAY, DAY)))


def test_exact_p95_in_the_stream(spark, events, tmp_path):
    rows, parts = events
    replay(spark, parts, f"{tmp_path}/in")
    out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True, p95="aggregate")
    queries.append_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out"), closed(flat_windows(rows, DAY)))


def test_messages_delivered_again_count_once(spark, events, tmp_path):
    """Every 7th message comes twice, in its own batch and again in the next."""
    rows, parts = events
    again = None
    for part in parts:
        batch = spark.read.parquet(part)
        twice = batch.filter(F.col("event_id") % 7 == 0)
        late = twice.filter(F.col("ts") > twice.agg(F.max("ts") - F.expr("interval 30 minutes")).first()[0])
        (batch.unionByName(twice) if again is None else batch.unionByName(twice).unionByName(again)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        again = spark.createDataFrame(late.collect(), late.schema)
        time.sleep(1.1)
    out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
    queries.append_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out"), closed(flat_windows(rows, DAY)))


@pytest.mark.parametrize("name", ["streamed_windows", "streamed_sliding"])
def test_streamed_p95_is_exact_in_busy_windows(spark, tmp_path, name):
    """Windows of some thousand distinct values, more than a sketch holds, equal their SQL; nothing passing is left behind."""
    made = tables.table(spark, MEDIUM, "events").withColumn("user_id", F.col("event_id") % 2 * 10)
    day = F.make_dt_interval(days=(F.col("event_id") % 2).cast("int"), secs=F.col("event_id") / 10)
    made.withColumn("ts", (F.lit("2024-01-01").cast("timestamp") + day).cast("timestamp_ntz")).coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    for other in TABLES:
        if other != "events":
            (tmp_path / f"{other}.parquet").symlink_to(f"{MEDIUM}/{other}.parquet")
    con = connect(str(tmp_path))
    con.execute(f"create or replace view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(tmp_path))
    assert got.agg(F.max("event_count")).first()[0] > 4_000
    assert difference(got, con, oracle.oracle_sql()[name]) is None
    assert not [p for p in Path(tables_root(spark).removeprefix("file:")).iterdir() if p.name.startswith("passing-")]


def test_exact_windows_by_day_equal_the_batch(spark, events, tmp_path):
    """Files one by one, a restart after each, and the last batch once more after a lost commit; empty regions and missing values too."""
    rows, parts = events
    holes = lambda df: df.withColumns({"region": F.when(F.col("event_id") % 5 == 0, F.lit("")).when(F.col("event_id") % 5 != 1, F.col("region")), "jitter_ms": F.when(F.col("cell_id") != "CELL_0007", F.col("jitter_ms"))})
    table = DayTable(spark, f"{tmp_path}/table", FLAT_WINDOW_SCHEMA)

    def run():
        queries.exact_windows_by_day(stream(spark, f"{tmp_path}/in"), table, f"{tmp_path}/checkpoint", 3 * DAY, DAY, "1 hour").awaitTermination()

    for part in parts:
        holes(spark.read.parquet(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    expected = closed(flat_windows(holes(rows), 3 * DAY, DAY))
    same(table.read().drop("day"), expected)
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for lost in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        lost.unlink(missing_ok=True)
    run()
    same(table.read().drop("day"), expected)


def test_state_is_bounded_by_sketches_and_panes(spark, tmp_path):
    """Many distinct values in one window: state of a fixed size, ranks within the sketch's error; one entry a pane, not a window."""
    n = 60_000
    values = {m: F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(10**6)) / 1000.0 for i, m in enumerate(FEATURES)}
    made = spark.range(n).select(F.col("id").alias("event_id"), (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 30)).alias("ts"), F.lit("CELL_0001").alias("cell_id"), F.lit("North").alias("region")).withColumns(values)
    made = made.select(*TELEMETRY_SCHEMA.names)
    made.write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([event(n, 9e5)], TELEMETRY_SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(TELEMETRY_SCHEMA).parquet(f"{tmp_path}/in")
    out = queries.window_stream(rows, 30, 10, "1 minute", flat=True, once=False)
    query = queries.append_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    first = next(p for p in query.recentProgress if p["numInputRows"])
    panes = max(s["numRowsTotal"] for s in first["stateOperators"])
    assert panes == 4  # three panes of the full half minute, one of the closing event
    used = max(s["memoryUsedBytes"] for s in first["stateOperators"])
    assert used < 4 * len(FEATURES) * 32_000 + 500_000  # the values themselves would be 2.9 MB
    found = {r["window_end"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    exact = {r["window_end"]: r for r in flat_windows(made, 30, 10).collect()}
    assert found.keys() == exact.keys() and len(exact) == 5
    for end, row in exact.items():
        inside = made.filter((F.col("ts") < F.lit(end)) & (F.col("ts") >= F.lit(end) - F.expr("interval 30 seconds")))
        ranks = inside.agg(*[F.avg((F.col(m) <= found[end][f"{m}_p95"]).cast("double")) for m in FEATURES]).first()
        assert all(abs(rank - 0.95) < 0.01 for rank in ranks)
        assert all(found[end][c] == row[c] for c in made.columns if c in row) and found[end]["event_count"] == row["event_count"]


def test_late_events_are_dropped_and_counted(spark, events, tmp_path):
    _, parts = events
    replay(spark, parts[::-1], f"{tmp_path}/in")
    out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
    assert counted(spark, out, tmp_path)[0] > 0


def test_late_rows_are_counted_beyond_the_kept_progress(spark, events, tmp_path):
    _, parts = events
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, "2")
    replay(spark, parts[::-1], f"{tmp_path}/in")
    out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
    late, query = counted(spark, out, tmp_path)
    spark.conf.unset(kept)
    left = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert late > 0 and late >= left


def test_restart_from_checkpoint_doubles_nothing(spark, events, tmp_path):
    rows, parts = events
    for part in parts:
        replay(spark, [part], f"{tmp_path}/in")
        out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
        queries.append_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out"), closed(flat_windows(rows, DAY)))


def test_batch_repeated_after_a_lost_commit_doubles_nothing(spark, events, tmp_path):
    rows, parts = events
    replay(spark, parts, f"{tmp_path}/in")

    def run():
        out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
        queries.append_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()

    run()
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for lost in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        lost.unlink(missing_ok=True)
    run()
    same(spark.read.parquet(f"{tmp_path}/out"), closed(flat_windows(rows, DAY)))


def test_table_by_day_takes_each_batch_once(spark, events, tmp_path):
    rows, parts = events
    expected = closed(flat_windows(rows, DAY))
    table = DayTable(spark, f"{tmp_path}/table", expected.schema, fan=2)

    def run():
        out = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour", flat=True)
        queries.append_by_day(out, table, f"{tmp_path}/checkpoint").awaitTermination()

    for part in parts:
        replay(spark, [part], f"{tmp_path}/in")
        run()
    same(table.read().drop("day"), expected)
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for lost in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the stream had died after the table's commit
        lost.unlink(missing_ok=True)
    run()
    same(table.read().drop("day"), expected)
    writers = table._newest()["batches"]
    assert len(writers) == 1 and len(next(iter(writers))) == 36  # the query's id
    monitored = table.read().withColumn("timestamp", F.col("window_end")).withColumn("label", F.lit("good"))
    plan = monitor.label_mix(monitored, F.lit("2024-01-29").cast("timestamp"), DAY)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_table_by_day_is_compacted(spark, tmp_path):
    schema = "cell_id string, window_end timestamp, n int"
    table = DayTable(spark, f"{tmp_path}/table", T._parse_datatype_string(schema), fan=3)
    assert table.read().count() == 0 and "day" in table.read().columns
    for batch in range(11):
        made = spark.range(4).select(F.lit("c").alias("cell_id"), (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("window_end"), F.lit(batch).alias("n"))
        rows = made if batch != 5 else made.limit(0)
        assert table.append(rows, batch, "a") and not table.append(rows, batch, "a")
        table.compact()
    assert sorted((r.n, str(r.day)) for r in table.read().collect()) == [(n, f"2024-03-0{d}") for n in range(11) if n != 5 for d in (1, 2, 3, 4)]
    levels = table._newest()["levels"]
    assert [len(x) for x in levels] == [1, 0, 1]  # ten batches with rows: nine merged twice, and one
    assert table.append(made, 0, "b")  # another writer has numbers of its own
    folders = {p.name for p in (tmp_path / "table" / "data").iterdir()}
    assert len(folders) < 10  # what no kept list names is gone


def test_messages_arrive_as_they_were_sent(spark, events, tmp_path):
    rows, parts = events
    replay(spark, parts[:1], f"{tmp_path}/in")
    sent = stream(spark, f"{tmp_path}/in")
    queries.send_lines(sent, f"{tmp_path}/lines", f"{tmp_path}/c1").awaitTermination()
    received = accepted(decode(file_stream(spark, f"{tmp_path}/lines"))).drop("event_id")
    queries.append_to_table(received, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(parts[0]).drop("event_id"))


def test_windows_scored_once_and_features_refreshed(spark, events, tmp_path):
    rows, parts = events
    samples = tables.with_labels(tables.windowed(spark, SMALL)).select(
        "cell_id", "window_end", *[F.col(f"avg_{m}").alias(m) for m in FEATURES], F.col("label").alias("network_health_score")
    )
    model = training.fit(training.prepare(samples), trees=5)
    online = OnlineTable(spark, f"{tmp_path}/online")
    for part in parts:
        replay(spark, [part], f"{tmp_path}/in")
        documents = queries.window_stream(stream(spark, f"{tmp_path}/in"), DAY, lateness="1 hour")
        queries.append_to_table(documents, f"{tmp_path}/windows", f"{tmp_path}/c1").awaitTermination()
        queries.score_inserted(
            spark, model, f"{tmp_path}/windows", f"{tmp_path}/predictions", f"{tmp_path}/c2"
        ).awaitTermination()
        inserted = queries.inserted_windows(spark, f"{tmp_path}/windows")
        queries.refresh_online(inserted, online, f"{tmp_path}/c3", every=None).awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/windows")
    predictions = spark.read.parquet(f"{tmp_path}/predictions")
    expected = scoring.score(model, stored)
    same(predictions.drop("timestamp"), expected.drop("timestamp"))
    assert predictions.select("windowed_metrics_id").distinct().count() == stored.count()
    same(online.read(), latest_features(feature_rows(stored)).select(*online.read().columns))


def test_streamed_sample_equals_the_batch(spark, events, tmp_path):
    """Two batches of doubled messages; of each window and cell the same rows as the batch sample, one cell being busy."""
    rows, parts = events
    busy = lambda df: df.withColumn("cell_id", F.when(F.col("event_id") % 3 == 0, "CELL_0001").otherwise(F.col("cell_id")))
    queries.use_rocksdb(spark)
    try:
        for part in parts:
            batch = busy(spark.read.parquet(part))
            batch.unionByName(batch.filter("event_id % 7 = 0")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(1.1)
        taken = sampled_windows(stream(spark, f"{tmp_path}/in").withWatermark("ts", "1 hour"), size=5 * DAY, cap=20, salts=3)
        queries.append_to_table(taken, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    finally:
        for key in queries.STATE_STORE:
            spark.conf.unset(key)
    ended = F.window("ts", f"{5 * DAY} seconds")["end"]
    expected = sampling.bounded_sample(busy(rows).withColumn("window_end", ended), ["cell_id", "window_end"], ["event_id"], cap=20)
    got = spark.read.parquet(f"{tmp_path}/out")
    last = expected.agg(F.max("window_end")).first()[0]
    same(got, expected.filter(F.col("window_end") < last).select(*got.columns))
    assert got.groupBy("cell_id", "window_end").count().agg(F.max("count")).first()[0] == 20


def test_timed_emission_counts_every_event_once(spark, telemetry, tmp_path):
    """Two cells, one emission each per interval; the counts and statistics add up."""
    queries.use_rocksdb(spark)
    regions = [None, None, "North", "South"]
    rows = [event(i, i, f"CELL_000{i % 2}", regions[i % 4], latency_ms=100.0 + i % 7 - 3) for i in range(40)]
    rows.append(event(40, 50, "CELL_0000", jitter_ms=None))
    rows += [event(i, i % 40, "CELL_0000", regions[i % 4], latency_ms=20.0 + i % 90, jitter_ms=i / 100) for i in range(41, 400)]
    source = telemetry(rows)
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = (
        timed_windows(stream(spark, f"{tmp_path}/in"), 2)
        .writeStream.format("memory")
        .queryName("timed")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(processingTime="1 second")
        .outputMode("append")
        .start()
    )
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("timed").count() < 2:
            time.sleep(1)
        time.sleep(5)
        emitted = spark.table("timed").drop("window_end", "ingested_at", "window_size_seconds")
        batch = cell_windows(source, 3600).drop("window_end", "ingested_at", "window_size_seconds")
        same(emitted, batch)
        states = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
        assert all(len(ops) == 2 for ops in states)
    finally:
        query.stop()
        for key in queries.STATE_STORE:
            spark.conf.unset(key)
