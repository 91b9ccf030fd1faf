"""What the physical plans must not hold, and what they must."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cellhealth.operators import features, monitor, quantiles, sampling, windows
from cellhealth.plans import registry, tables
from cellhealth.schemas import FEATURE_SCHEMA, FEATURES
from conftest import MEDIUM, SMALL, at

QUERIES = registry.queries()
EVENTS = re.compile(r"FileScan parquet .*events\.parquet")
FITTED = {"forest_confusion", "forest_predictions", "forest_scored", "forest_holdout", "forest_golden", "forest_folds"}


def physical(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_python_no_cross_join_no_raw_rows_in_one_task(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    for node in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # Only what was already aggregated comes together in one task.
            assert "Aggregate" in lines[i + 1], lines[i + 1]


@pytest.mark.parametrize(
    "name, columns",
    [
        ("event_rate", {"ts", "user_id"}),
        ("iso_times", {"event_id", "ts", "user_id"}),
        ("asof_features", {"event_id", "ts", "user_id", "value", "props"}),
    ],
)
def test_scans_read_only_what_is_needed(spark, name, columns):
    schemas = re.findall(r"events\.parquet\].*?ReadSchema: struct<(.*?)>", physical(QUERIES[name](spark, SMALL)))
    read = {field.split(":")[0] for schema in schemas for field in schema.split(",")}
    assert read <= columns


def test_row_operators_do_not_shuffle(spark):
    for name in ("parse_telemetry", "anomaly_events", "rounded_events", "anomaly_archetype", "scorable_rows", "iso_times"):
        plan = physical(QUERIES[name](spark, SMALL))
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_flagship_scans(spark):
    """One scan for the statistics; of the p95s, one for the coarse counts and one in the result, each joined to few rows."""
    keyed = tables.telemetry(spark, MEDIUM).withColumn("window", F.window("ts", "5 days"))
    assert len(EVENTS.findall(physical(windows._windows_by_hash(keyed, 5 * tables.DAY, 5 * tables.DAY, ("avg", "min", "max"), FEATURES)))) == 1
    found = physical(QUERIES["window_stats_wide"](spark, MEDIUM))
    assert len(EVENTS.findall(found)) == 1 and "BroadcastHashJoin" in found
    assert len(EVENTS.findall(physical(QUERIES["window_stats"](spark, SMALL)))) == 0  # every p95 is a maximum: nothing is read again


@pytest.mark.parametrize("size, slide", [(tables.DAY, tables.DAY), (600, 600), (3 * tables.DAY, tables.DAY)])
def test_events_are_hashed_not_sorted(spark, size, slide):
    """Nothing sorts by key before the events have been aggregated once."""
    keyed = tables.telemetry(spark, SMALL).withColumn("window", F.window("ts", f"{slide} seconds"))
    rows = keyed.select(F.col("window.start").alias("start"), "cell_id", *FEATURES)
    groups = quantiles.numbered(rows.groupBy("start", "cell_id").agg(*quantiles.ranges(FEATURES)), "test-ranges")
    for df in (windows._windows_by_hash(keyed, size, slide, ("avg", "min", "max"), FEATURES), quantiles.coarse_counts(rows, groups, ["start", "cell_id"], FEATURES)):
        plan = physical(df).splitlines()
        scan = next(i for i, line in enumerate(plan) if EVENTS.search(line))
        above = [line for line in plan[:scan] if "Aggregate" in line]
        assert "HashAggregate" in above[-1] and "ObjectHashAggregate" not in above[-1] and "SortAggregate" not in above[-1]


def test_reply_scans(spark):
    """Recent predictions, the newest ones, and the features; the anchor's subquery stands beside them."""
    scans = [re.sub("#[0-9]+L?", "", found) for found in re.findall(r"FileScan parquet \[(.*?)\]", physical(QUERIES["dashboard_reply"](spark, SMALL)))]
    assert len([read for read in scans if set(read.split(",")) - {"last_ts", "window_end", "day"}]) == 3, scans


def test_lookup_opens_only_the_parts_asked_for(spark):
    online = tables.online_table(spark, SMALL)
    asked = online.read().select("cell_id").orderBy("cell_id").limit(2)
    found = online.lookup(asked)
    parts = {re.search("part=([0-9]+)", f)[1] for f in found.inputFiles() if "/online/" in f}
    wanted = set(online._touched(asked))
    assert wanted <= parts and len(wanted) <= 2
    held = online._rows(sorted(online._newest()[k] for k in wanted))
    assert {re.search("part=([0-9]+)", f)[1] for f in held.inputFiles()} == wanted


def test_feed_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in physical(QUERIES["recent_feed"](spark, SMALL))


def test_lookback_reaches_a_stored_table_scan(spark, tmp_path):
    tables.predictions(spark, SMALL).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    plan = physical(monitor.label_mix(stored, F.lit(at(0))))
    assert "GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,label:string>" in plan


def test_small_feature_table_leaves_events_in_place(spark, tmp_path):
    tables.telemetry(spark, SMALL).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([], FEATURE_SCHEMA).write.parquet(f"{tmp_path}/f")
    joined = features.asof_features(spark.read.parquet(f"{tmp_path}/e"), spark.read.schema(FEATURE_SCHEMA).parquet(f"{tmp_path}/f"))
    assert "BroadcastHashJoin" in physical(joined)


def test_bounded_sample_limits_before_the_shuffle(spark):
    rows = tables.telemetry(spark, SMALL).select("cell_id", "event_id")
    assert "WindowGroupLimit" in physical(sampling.bounded_sample(rows, ["cell_id"], ["event_id"]))


def test_hot_cell_keeps_every_event(spark, tmp_path):
    """A third of the events in one cell: the as-of join still gives one row per event."""
    rows = tables.telemetry(spark, SMALL).select("event_id", "cell_id", "ts")
    hot = rows.withColumn("cell_id", F.when(F.col("event_id") % 3 == 0, "CELL_0001").otherwise(F.col("cell_id")))
    table = tables.windowed(spark, SMALL).drop("last_ts")
    joined = features.asof_features(hot, table, ttl_seconds=2 * tables.DAY, bucket_seconds=3600)
    assert joined.count() == rows.count()
    assert set(f"avg_{m}" for m in FEATURES) <= set(joined.columns)
