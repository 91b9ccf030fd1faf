"""Operators on literal rows."""

from __future__ import annotations

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellhealth.functions import labels, numeric, telemetry as fn
from cellhealth.operators import bands, evaluate, events, features, latest, monitor, sampling
from cellhealth.operators.windows import cell_windows, flat_windows, metric_value
from cellhealth.schemas import (
    ARCHETYPES,
    CELL_FEATURES,
    FEATURE_SCHEMA,
    FEATURES,
    GOLDEN_VECTORS,
    PREDICTION_SCHEMA,
    WINDOW_SCHEMA,
)
from cellhealth.sources import tables
from cellhealth.sources.telemetry import accepted, decode, keyed_json, rejected
from conftest import at, event


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# -- expressions --------------------------------------------------------------------------------


def test_half_up_uses_the_binary_value(spark):
    for x, places, wanted in ((2.675, 2, 2.68), (1.0005, 3, 1.001), (-0.0005, 3, 0.0), (12.0, 2, 12.0)):
        assert one(spark, numeric.half_up(F.lit(x), places)) == wanted
    assert one(spark, numeric.half_up(F.lit(None).cast("double"))) is None


def test_clamp_keeps_nulls(spark):
    assert [one(spark, numeric.clamp(F.lit(x), 5.0, 80.0)) for x in (1.0, 30.0, 99.0)] == [5.0, 30.0, 80.0]
    assert one(spark, numeric.clamp(F.lit(None).cast("double"), 5.0, 80.0)) is None
    assert one(spark, numeric.clamp(F.lit(-1.0), 0.0, None)) == 0.0


def test_epoch_to_the_microsecond(spark):
    ts = fn.from_epoch(F.lit(1704067207.179575))
    assert one(spark, fn.iso_utc(ts)) == "2024-01-01T00:00:07.179575Z"
    assert one(spark, fn.to_epoch(ts)) == 1704067207.179575


def test_iso_text_has_a_fixed_width(spark):
    assert one(spark, fn.iso_utc(F.lit("2024-01-01 00:00:00").cast("timestamp"))) == "2024-01-01T00:00:00.000000Z"


@pytest.mark.parametrize("age, text", [(0, "0s ago"), (59, "59s ago"), (60, "1m ago"), (90, "2m ago"), (3599, "60m ago"), (7300, "2h ago")])
def test_age_text(spark, age, text):
    assert one(spark, fn.age_text(F.lit(age).cast("bigint"))) == text


@pytest.mark.parametrize("number, name", [(0, "CELL_0000"), (49, "CELL_0049"), (12345, "CELL_12345")])
def test_cell_names(spark, number, name):
    assert one(spark, fn.cell_name(F.lit(number))) == name


def test_bins_start_at_the_epoch(spark):
    stamp = F.lit("2024-01-01 00:07:31").cast("timestamp")
    assert one(spark, fn.iso_utc(fn.bin_start(stamp, 300))) == "2024-01-01T00:05:00.000000Z"


def test_peak_hours_include_both_ends(spark):
    factors = [one(spark, fn.peak_factor(F.lit(f"2024-01-01 {h:02}:30:00").cast("timestamp"))) for h in (7, 8, 18, 19)]
    assert factors == [0.7, 1.0, 1.0, 0.7]


def test_label_names_and_codes(spark):
    codes = (0.0, 1.0, 2.0, 3.0, -1.0)
    assert [one(spark, labels.label_name(F.lit(c))) for c in codes] == ["excellent", "good", "poor", "unknown", "unknown"]
    assert [one(spark, labels.label_code(F.lit(n))) for n in ("excellent", "good", "poor", "none")] == [0, 1, 2, None]


def test_profile_labels_of_the_golden_vectors(spark):
    rows = spark.createDataFrame([(*v, w) for v, w in GOLDEN_VECTORS], [*FEATURES, "wanted"])
    found = rows.select(labels.label_name(labels.profile_code()).alias("label"), "wanted").collect()
    assert all(r["label"] == r["wanted"] for r in found)


# -- messages -----------------------------------------------------------------------------------


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


GOOD = {"timestamp": 1704067207.5, "cell_id": "CELL_0007", "imsi": "5051234567890", "region": "North", **dict(zip(FEATURES, (-50, 100, 20, 0.5, 0.5, 2)))}


def without(*names, **changes):
    return json.dumps({**{k: v for k, v in GOOD.items() if k not in names}, **changes})


@pytest.mark.parametrize(
    "text",
    ["", "nonsense", without()[:-5], "[1, 2]", f"[{without()}]", "5", '"text"', "null", without(latency_ms="slow"), without("timestamp")],
)
def test_malformed_messages_are_set_aside(spark, text):
    decoded = decode(messages(spark, text, without()))
    assert [r["value"] for r in rejected(decoded).collect()] == [text]
    assert accepted(decoded).count() == 1


def test_null_message_is_set_aside(spark):
    decoded = decode(messages(spark, None))
    assert (rejected(decoded).count(), accepted(decoded).count()) == (1, 0)


def test_defaults_of_missing_and_null_fields(spark):
    def fields(text):
        return accepted(decode(messages(spark, text))).first()

    assert fields(without("cell_id"))["cell_id"] == "unknown"
    assert fields(without("region"))["region"] == "unknown"
    assert fields(without(region=None))["region"] is None
    assert fields(without(region=""))["region"] == ""
    assert fields(without("jitter_ms"))["jitter_ms"] is None
    assert fields(without(jitter_ms=None))["jitter_ms"] is None


def test_subscriber_is_dropped_unless_asked_for(spark):
    decoded = decode(messages(spark, without()))
    assert "imsi" not in accepted(decoded).columns
    assert accepted(decoded, keep_subscriber=True).first()["imsi"] == "5051234567890"


def test_arrival_time_stands_in_for_event_time(spark):
    arrived = messages(spark, without("timestamp")).withColumn("arrived_at", F.lit("2024-01-05").cast("timestamp"))
    assert fn_iso(accepted(decode(arrived))) == "2024-01-05T00:00:00.000000Z"


def fn_iso(df):
    return df.select(fn.iso_utc(F.col("ts")).alias("t")).first()["t"]


def test_keyed_json_round_trip(telemetry):
    rows = telemetry([event(1, 1.25), event(2, 2.5, region=None, jitter_ms=None)])
    sent = keyed_json(rows)
    assert sent.schema["key"].dataType == T.BinaryType()
    assert bytes(sent.first()["key"]) == b"CELL_0001"
    back = accepted(decode(sent.select("value"))).drop("event_id").orderBy("ts").collect()
    kept = rows.drop("event_id").orderBy("ts").collect()
    assert back[0] == kept[0]
    # A null field does not travel, and a missing region reads as unknown.
    assert (back[1]["region"], back[1]["jitter_ms"]) == ("unknown", None)


# -- rows ---------------------------------------------------------------------------------------


def test_band_join(spark, telemetry):
    """10,000 bands by a binned index, against each row tried with each band."""
    rng = random.Random(4)
    made = []
    for i in range(10_000):
        sides = []
        for _ in FEATURES:
            low = rng.choice((rng.uniform(0, 100), float(rng.randrange(100))))
            sides += [low, low + rng.choice((0.0, 1.0, 30.0, 60.0, 99.0))]
        made.append((f"b{i}", *sides))
    made += [("none", *[None] * 12), ("crossed", *[5.0, 1.0] * 6), ("all", *[-1e6, 1e6] * 6)]
    names = ", ".join(f"{m}_low double, {m}_high double" for m in FEATURES)
    table = spark.createDataFrame(made, f"band string, {names}")
    points = [[float(rng.randrange(160)) for _ in FEATURES] for _ in range(150)]
    points += [list(made[i][1::2]) for i in range(20)] + [list(made[i][2::2]) for i in range(20, 40)] + [[2e6] * 6]
    rows = [event(i, 0, **dict(zip(FEATURES, p))) for i, p in enumerate(points)] + [event(900, 0, latency_ms=None)]
    joined = bands.band_join(telemetry(rows).withColumn("band", F.lit("clash")), table, "band")
    expected = Counter()
    for i, p in enumerate(points):
        held = [b[0] for b in made if b[1] is not None and all(b[1 + 2 * k] <= x <= b[2 + 2 * k] for k, x in enumerate(p))]
        expected.update((i, h) for h in held or [None])
    expected[900, None] += 1
    assert Counter((r.event_id, r.band) for r in joined.collect()) == expected
    plan = joined._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nothing = bands.band_join(telemetry(rows[:3]), table.limit(0), "band")
    assert [r.band for r in nothing.collect()] == [None] * 3


def test_archetypes(telemetry):
    middles = {name: [(lo + hi) / 2 for lo, hi in bands] for name, bands in ARCHETYPES.items()}
    rows = [event(i, 0, **dict(zip(FEATURES, values))) for i, values in enumerate(middles.values())]
    rows.append(event(9, 0, latency_ms=900.0))
    found = events.with_archetypes(telemetry(rows)).orderBy("event_id").collect()
    assert [r["archetype"] for r in found] == [*middles, None]


def test_checked_ids(spark):
    rows = spark.createDataFrame([("CELL_0001", "5051012345678"), ("CELL_1", "505101234567"), ("cell_0001", "x")], "cell_id string, imsi string")
    found = events.checked_ids(rows).collect()
    assert [(r["cell_id_ok"], r["imsi_ok"]) for r in found] == [(True, True), (False, False), (False, False)]


def test_metric_is_read_from_a_struct_or_a_number(telemetry, spark):
    rows = telemetry([event(1, latency_ms=33.0)])
    stored = cell_windows(rows)
    assert stored.select(metric_value(stored, "latency_ms").alias("x")).first()["x"] == 33.0
    assert rows.select(metric_value(rows, "latency_ms").alias("x")).first()["x"] == 33.0
    assert features.feature_rows(stored).first()["avg_latency_ms"] == 33.0


def test_feature_row_defaults(spark):
    nothing = spark.createDataFrame([tuple([None, None, None, "CELL_0001"] + [None] * 10)], WINDOW_SCHEMA)
    row = features.feature_rows(nothing).first()
    assert row["region"] == "unknown" and row["event_count"] == 0 and row["avg_jitter_ms"] == 0.0
    assert row["window_end"] is not None
    assert features.feature_rows(nothing).schema.simpleString() == FEATURE_SCHEMA.simpleString()


def test_scorable_rows(telemetry):
    rows = telemetry([event(1), event(2, jitter_ms=None)])
    assert [r["event_id"] for r in features.scorable(rows).collect()] == [1]


def feature(cell, seconds, latency, region="North"):
    return (cell, at(seconds), -50.0, 100.0, float(latency), 0.5, 0.5, 2.0, 10, 0, region)


def test_latest_has_one_winner_on_ties(spark):
    rows = [feature("A", 0, 1), feature("A", 10, 2), feature("A", 10, 3), feature("B", 5, 4)]
    for order in range(5):
        shuffled = random.Random(order).sample(rows, len(rows))
        found = features.latest_features(spark.createDataFrame(shuffled, FEATURE_SCHEMA).repartition(3))
        assert sorted((r["cell_id"], r["avg_latency_ms"]) for r in found.collect()) == [("A", 3.0), ("B", 4.0)]


def test_lookup_gives_nulls_for_unknown_and_outdated(spark):
    table = spark.createDataFrame([feature("A", 0, 1), feature("B", 5000, 2)], FEATURE_SCHEMA)
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "cell_id string")
    plain = {r["cell_id"]: r["avg_latency_ms"] for r in features.lookup(table, asked).collect()}
    assert plain == {"A": 1.0, "B": 2.0, "C": None}
    fresh = features.lookup(table, asked, now=F.lit(at(5000 + 1799)))
    assert {r["cell_id"]: r["avg_latency_ms"] for r in fresh.collect()} == {"A": None, "B": 2.0, "C": None}


def test_asof_join_against_brute_force(spark):
    rng = random.Random(7)
    table = [feature(rng.choice("AB"), rng.randrange(0, 400), i) for i in range(120)]
    table = list({(r[0], r[1]): r for r in table}.values())
    moments = [(i, rng.choice("ABC"), at(rng.randrange(-20, 600))) for i in range(300)]
    for ttl, bucket in ((30, 7), (5, 10), (90, 10)):
        frame = features.asof_features(
            spark.createDataFrame(moments, "event_id bigint, cell_id string, ts timestamp"),
            spark.createDataFrame(table, FEATURE_SCHEMA),
            ttl_seconds=ttl,
            bucket_seconds=bucket,
        )
        found = {r["event_id"]: r["avg_latency_ms"] for r in frame.collect()}
        assert frame.count() == len(moments)
        for number, cell, ts in moments:
            young = [r for r in table if r[0] == cell and 0 <= (ts - r[1]).total_seconds() < ttl]
            wanted = max(young, key=lambda r: r[1])[4] if young else None
            assert found[number] == wanted, (ttl, bucket, number)


def test_asof_at_the_edges_of_the_ttl(spark):
    table = spark.createDataFrame([feature("A", 100, 1)], FEATURE_SCHEMA)
    moments = [(i, "A", at(s)) for i, s in enumerate((99.999999, 100, 1899.999999, 1900))]
    frame = features.asof_features(spark.createDataFrame(moments, "event_id bigint, cell_id string, ts timestamp"), table)
    assert [r["avg_latency_ms"] for r in frame.orderBy("event_id").collect()] == [None, 1.0, 1.0, None]


def test_store_status(spark):
    table = spark.createDataFrame([feature("A", 0, 1), feature("B", 9, 2)], FEATURE_SCHEMA)
    row = features.store_status(table).first()
    assert row["cells_materialized"] == 2
    empty = features.store_status(tables.empty(spark, FEATURE_SCHEMA)).first()
    assert (empty["cells_materialized"], empty["last_updated"]) == (0, None)


# -- samples and folds --------------------------------------------------------------------------


def numbered(spark, n=1000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("label"))


def test_bounded_sample_is_bounded_and_repeatable(spark):
    rows = numbered(spark)
    first = sampling.bounded_sample(rows, ["label"], ["id"], cap=50)
    again = sampling.bounded_sample(rows.repartition(7), ["label"], ["id"], cap=50, salts=3)
    assert {r["label"]: r["count"] for r in first.groupBy("label").count().collect()} == {"a": 50, "b": 50, "c": 50}
    assert first.exceptAll(again).count() == 0
    other = sampling.bounded_sample(rows, ["label"], ["id"], cap=50, seed=1)
    assert first.exceptAll(other).count() > 0
    assert sampling.bounded_sample(rows, ["label"], ["id"], cap=2000).count() == 1000


def test_split_takes_a_rounded_up_share_of_each_class(spark):
    rows = numbered(spark, 1001)
    split = sampling.stratified_split(rows, "label", ["id"])
    assert split.count() == 1001
    for r in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == -(-r["n"] // 5)
    again = sampling.stratified_split(rows.repartition(5), "label", ["id"])
    assert split.exceptAll(again).count() == 0


def test_folds_are_equal_blocks_of_each_class(spark):
    folds = sampling.cross_validation_folds(numbered(spark, 1003), "label", ["id"])
    for r in folds.groupBy("label").pivot("fold", range(5)).count().collect():
        sizes = [r[str(i)] for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_split_and_folds_of_tiny_classes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "id bigint, label string")
    split = {r["id"]: r["is_test"] for r in sampling.stratified_split(rows, "label", ["id"]).collect()}
    assert split[1] and sum(split[i] for i in (2, 3, 4)) == 1
    folds = [r["fold"] for r in sampling.cross_validation_folds(rows, "label", ["id"]).filter("label = 'b'").collect()]
    assert len(set(folds)) == 3


def test_class_weights(spark):
    found = {r["label"]: r["weight"] for r in evaluate.class_weights(numbered(spark, 21), "label").collect()}
    assert found == {"a": 21 / (3 * 7), "b": 21 / (3 * 2), "c": 21 / (3 * 12)}


def test_standardised(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, y double")
    found = evaluate.standardised(rows, ["x", "y"]).collect()
    assert [r["x"] for r in found] == [-1.224745, 0.0, 1.224745, None]
    assert [r["y"] for r in found] == [0.0] * 4


def test_quality_of_a_known_confusion(spark):
    rows = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("b", "c", 2)], "label string, prediction string, n bigint")
    row = evaluate.quality(rows).first()
    # a: p 1, r 3/4, f 6/7; b: p 2/3, r 1/2, f 4/7; c has no support.
    assert row["accuracy"] == 0.625
    assert row["recall"] == 0.625
    assert row["precision"] == pytest.approx((4 * 1 + 4 * 2 / 3) / 8, abs=1e-6)
    assert row["f1"] == pytest.approx((4 * 6 / 7 + 4 * 4 / 7) / 8, abs=1e-6)


# -- monitoring ---------------------------------------------------------------------------------


def predicted(spark, rows):
    return spark.createDataFrame(
        [(c, r, at(s), at(s), label) for c, r, s, label in rows],
        "cell_id string, region string, window_end timestamp, timestamp timestamp, label string",
    )


def test_monitoring_on_no_rows(spark):
    none = predicted(spark, [])
    now = F.lit(at(0))
    table = tables.empty(spark, FEATURE_SCHEMA)
    assert monitor.event_totals(table, now).first().asDict() == {"total_events": 0, "total_docs": 0}
    assert monitor.recent_count(none, now).first()["predictions"] == 0
    assert monitor.feed_active(none, now).first()["active"] is False
    assert {r["label"]: r["count"] for r in monitor.label_kpis(none, now).collect()} == {"excellent": 0, "good": 0, "poor": 0}


def test_lookback_includes_its_edge_and_has_no_upper_bound(spark):
    rows = predicted(spark, [("A", "N", -61, "good"), ("A", "N", -60, "good"), ("A", "N", 500, "good")])
    assert monitor.recent_count(rows, F.lit(at(0))).first()["predictions"] == 2


def test_region_shares_leave_out_regions_without_known_labels(spark):
    rows = predicted(spark, [("A", "N", 0, "good"), ("A", "N", 1, "poor"), ("A", "N", 2, "good"), ("B", "S", 0, "unknown")])
    found = monitor.region_shares(rows, F.lit(at(0))).collect()
    assert [tuple(r) for r in found] == [("N", 0.0, 66.7, 33.3)]


def test_label_series_counts_other_labels_apart(spark):
    rows = predicted(spark, [("A", "N", 0, "good"), ("A", "N", 1, "odd"), ("A", "N", 2, None), ("A", "N", 61, "poor")])
    found = monitor.label_series(rows, F.lit(at(0))).drop("bucket").collect()
    assert [tuple(r) for r in found] == [(0, 1, 0, 2), (0, 0, 1, 0)]


def test_grid_shows_every_cell(spark):
    rows = predicted(spark, [("A", "N", 0, "good"), ("A", "N", 5, "poor"), ("B", "N", 1, "good")])
    cells = spark.createDataFrame([("A",), ("B",), ("C",)], "cell_id string")
    table = spark.createDataFrame([feature("A", 0, 12.34)], FEATURE_SCHEMA)
    found = {r["cell_id"]: (r["label"], r["latency_avg"]) for r in monitor.cell_grid(cells, rows, table).collect()}
    assert found == {"A": ("poor", 12.3), "B": ("good", None), "C": ("unknown", None)}
    many = predicted(spark, [(f"C{i}", "N", i, "good") for i in range(60)])
    cells = spark.createDataFrame([(f"C{i}",) for i in range(61)], "cell_id string")
    assert sum(r["label"] == "good" for r in monitor.cell_grid(cells, many, table).collect()) == 60


def test_silent_cells_in_pieces(spark):
    ends = {"A": (0, 1, 5, 40), "B": (3,), "C": tuple(range(41))}
    rows = spark.createDataFrame([(c, at(60 * i)) for c, found in ends.items() for i in found], "cell_id string, window_end timestamp")
    expected = {(c, at(60 * i).replace(tzinfo=None)) for c, found in ends.items() for i in range(41) if i not in found}
    for piece in (1, 7, 512):
        assert {(r["cell_id"], r["window_end"].replace(tzinfo=None)) for r in monitor.silent_cells(rows, 60, piece).collect()} == expected


def test_event_rate_over_a_gap_of_years(telemetry):
    rows = telemetry([event(0, 0), event(1, 24 * 365 * 86_400)])
    rate = monitor.event_rate(rows, 3600)
    assert rate.count() == 24 * 365 * 24 + 1
    assert rate.filter("events_per_second > 0").count() == 2


def test_rows_without_label_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "label string, n int")
    assert evaluate.with_class_weights(rows.filter("label is not null"), "label").count() == 2
    with pytest.raises(Exception, match="a row has no label"):
        evaluate.with_class_weights(rows, "label").collect()


def test_unusable_numbers_and_times_are_set_aside(spark):
    def message(number, **fields):
        body = {"timestamp": 1_709_251_200.0, "cell_id": "A", "latency_ms": 20.0} | fields
        return number, json.dumps(body).replace('"1e999"', "1e999")

    sent = [
        message(0), message(1, latency_ms=1e30), message(2, jitter_ms="1e999"), message(3, timestamp=1e18), message(4, timestamp=-5.0),
        message(5, latency_ms=-1e7), message(6, timestamp=time.time() + 3 * 86_400), message(7, latency_ms=None), message(8, latency_ms=999_999.0),
    ]
    decoded = decode(spark.createDataFrame(sent, "event_id long, value string"))
    good = accepted(decoded)
    assert {r["event_id"] for r in good.collect()} == {0, 7, 8}
    assert {r["event_id"] for r in rejected(decoded).collect()} == {1, 2, 3, 4, 5, 6}
    assert flat_windows(good, 10).count() == 1
    late = spark.createDataFrame([(1, '{"timestamp": 1709251200.0}', at(0)), (2, '{"timestamp": 1709251200.0}', at(-3 * 86_400)), (3, "{}", at(0))], "event_id long, value string, arrived_at timestamp")
    assert {r["event_id"] for r in accepted(decode(late)).collect()} == {1, 3}


def test_event_rate_fills_silent_buckets(telemetry):
    rows = telemetry([event(i, s) for i, s in enumerate((0, 1, 4, 12, 86_399, 86_401))])
    found = monitor.event_rate(rows, 5).orderBy("bucket").collect()
    assert len(found) == 86_400 // 5 + 1
    assert [(r["total"], r["events_per_second"]) for r in found[:3]] == [(3, 0.6), (3, 0.0), (4, 0.2)]
    assert [r["total"] for r in found[-2:]] == [5, 6]


def test_filters_default_to_the_last_hour(spark):
    rows = predicted(spark, [("A", "N", 0, "good"), ("A", "N", 3600, "good"), ("B", "S", 7200, "good")])
    assert monitor.filtered(rows, anchor=F.lit(at(7200))).count() == 2
    assert monitor.filtered(rows, region="S", anchor=F.lit(at(7200))).count() == 1
    assert monitor.filtered(rows, cell_id="A", window_end=(at(0), at(3600))).count() == 2


# -- tables -------------------------------------------------------------------------------------


def test_replace_clear_and_typed_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert tables.read_typed(spark, path, FEATURE_SCHEMA).count() == 0
    rows = spark.createDataFrame([feature("A", 0, 1)], FEATURE_SCHEMA)
    tables.replace(rows.withColumn("_id", F.lit("x")), path)
    assert tables.scan(spark, path).columns == FEATURE_SCHEMA.names
    assert tables.read_typed(spark, path, FEATURE_SCHEMA).count() == 1
    tables.clear(spark, path, PREDICTION_SCHEMA)
    cleared = spark.read.parquet(path)
    assert cleared.count() == 0 and cleared.columns == PREDICTION_SCHEMA.names


def test_online_table_keeps_the_newest(spark, tmp_path):
    online = tables.OnlineTable(spark, f"{tmp_path}/online", keep=2)
    assert online.read().count() == 0
    batches = [[feature("A", 0, 1), feature("B", 0, 2)], [feature("A", 10, 3)], [feature("A", 5, 4), feature("C", 1, 5)]]
    for rows in batches:
        online.upsert(spark.createDataFrame(rows, FEATURE_SCHEMA))
    assert sorted((r["cell_id"], r["avg_latency_ms"]) for r in online.read().collect()) == [("A", 3.0), ("B", 2.0), ("C", 5.0)]
    before = sorted(online.read().collect())
    online.upsert(spark.createDataFrame(batches[-1], FEATURE_SCHEMA))
    assert sorted(online.read().collect()) == before
    kept = sorted(p.name for p in (tmp_path / "online" / "commits").iterdir() if p.name.isdigit())
    assert kept == ["0000000003", "0000000004"]


def test_half_written_upsert_is_not_seen(spark, tmp_path):
    online = tables.OnlineTable(spark, f"{tmp_path}/online")
    online.upsert(spark.createDataFrame([feature("A", 0, 1)], FEATURE_SCHEMA))
    (tmp_path / "online" / "data" / "half").mkdir()
    assert online.read().count() == 1
    online.upsert(spark.createDataFrame([feature("B", 0, 1)], FEATURE_SCHEMA))
    assert online.read().count() == 2


def test_upsert_rewrites_only_its_parts_and_refuses_a_second_writer(spark, tmp_path):
    online = tables.OnlineTable(spark, f"{tmp_path}/online", parts=8)
    cells = [f"C{i}" for i in range(40)]
    online.upsert(spark.createDataFrame([feature(c, 0, 1) for c in cells], FEATURE_SCHEMA))
    before = online._listed(1)
    online.upsert(spark.createDataFrame([feature("C7", 5, 9)], FEATURE_SCHEMA))
    after = online._listed(2)
    assert sum(before[k] != after[k] for k in after) == 1 and online.read().count() == 40
    stale = tables.OnlineTable(spark, f"{tmp_path}/online", parts=8)
    stale._commits = lambda: [1]  # as read before the second write
    with pytest.raises(RuntimeError, match="another writer"):
        stale.upsert(spark.createDataFrame([feature("C8", 5, 9)], FEATURE_SCHEMA))
    assert {r["avg_latency_ms"] for r in online.read().filter("cell_id = 'C7'").collect()} == {9.0}


def test_view_names_its_features():
    assert CELL_FEATURES.features[0] == "avg_signal_strength_dbm" and "cell_id" not in CELL_FEATURES.features
