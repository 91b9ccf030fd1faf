"""Window statistics against a plain accumulator, and the edge inputs one by one."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellhealth.operators import quantiles
from cellhealth.operators.quantiles import p95_approx_per_group, p95_per_group
from cellhealth.operators.windows import cell_windows, flat_windows, window_regions
from cellhealth.schemas import FEATURES, STATS, WINDOW_SCHEMA
from conftest import START, at, event


def half_up(x: float) -> float:
    return math.floor(x * 1e3 + 0.5) / 1e3


def accumulate(rows, size, slide=None):
    """The same windows, event by event, in plain Python."""
    slide = slide or size
    groups: dict = {}
    for _, ts, cell, region, *metrics in rows:
        second = (ts - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds()
        start = math.floor(second / slide) * slide
        while start > second - size:
            groups.setdefault((cell, start + size), []).append((ts, region, metrics))
            start -= slide
    found = {}
    for (cell, end), members in groups.items():
        regions = sorted((ts, r) for ts, r, _ in members if r is not None)
        stats = []
        for i in range(len(FEATURES)):
            values = sorted(m[i] for _, _, m in members if m[i] is not None)
            if not values:
                stats += [0.0] * 4
                continue
            total = sum(Decimal(str(half_up(v))) for v in values)
            mean = (total * 1000 / len(values)).quantize(Decimal(1), ROUND_HALF_UP) if total >= 0 else None
            average = float(mean) / 1e3 if mean is not None else math.floor(float(total * 1000) / len(values) + 0.5) / 1e3
            p95 = values[min(int(len(values) * 0.95), len(values) - 1)]
            stats += [average, half_up(values[0]), half_up(values[-1]), half_up(p95)]
        odd = 0
        for _, _, (signal, _, latency, drops, loss, _) in members:
            odd += (latency or 0) > 100 or (signal or 0) < -80 or (drops or 0) > 2 or (loss or 0) > 5
        region = (regions[0][1] if regions else None) or "unknown"
        found[(cell, end)] = (region, len(members), odd, *stats)
    return found


def as_dict(flat):
    names = [f"{m}_{s}" for m in FEATURES for s in STATS]
    rows = flat.select(
        "cell_id", F.unix_seconds("window_end").alias("end"), "region", "event_count", "anomaly_event_count", *names
    ).collect()
    return {(r[0], r[1]): tuple(r[2:]) for r in rows}


metric = st.one_of(st.none(), st.integers(-100_000, 250_000).map(lambda n: n / 1000))
rows_of = st.lists(
    st.tuples(
        st.integers(0, 120),
        st.sampled_from(["CELL_0001", "CELL_0002"]),
        st.sampled_from(["North", "", None, "South"]),
        *[metric] * 6,
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_of)
def test_windows_equal_accumulator(telemetry, rows):
    rows = [(i, at(s), cell, region, *ms) for i, (s, cell, region, *ms) in enumerate(rows)]
    df = telemetry(rows)
    expected = accumulate(rows, 30)
    assert as_dict(flat_windows(df, 30, p95="aggregate")) == expected
    assert as_dict(flat_windows(df, 30, p95="refined")) == expected
    assert as_dict(flat_windows(df, 30, slide=10)) == accumulate(rows, 30, 10)


@pytest.mark.parametrize("n", [1, 19, 20, 21, 40, 500, 501])
def test_p95_takes_the_floor_rank(telemetry, n):
    order = random.Random(n).sample(range(n), n)
    df = telemetry([event(i, 0, latency_ms=float(v)) for i, v in enumerate(order)])
    wanted = float(min(int(n * 0.95), n - 1))
    assert flat_windows(df, 10, p95="aggregate").first()["latency_ms_p95"] == wanted
    assert flat_windows(df, 10, p95="refined").first()["latency_ms_p95"] == wanted
    assert p95_per_group(df, ["cell_id"]).first()["latency_ms_p95"] == wanted


def test_sketched_p95_keeps_its_rank_error(telemetry):
    n, accuracy = 4000, 100
    df = telemetry([event(i, 0, latency_ms=float(i)) for i in range(n)])
    found = p95_approx_per_group(df, ["cell_id"], ["latency_ms"], accuracy).first()["latency_ms_p95"]
    assert abs(found - 0.95 * n) <= n / accuracy + 1


def test_thresholds_are_strict(telemetry):
    on = dict(latency_ms=100.0, signal_strength_dbm=-80.0, call_drop_rate_percent=2.0, packet_loss_percent=5.0)
    beyond = dict(latency_ms=100.01, signal_strength_dbm=-80.01, call_drop_rate_percent=2.001, packet_loss_percent=5.001)
    rows = [event(0, 0, **on)] + [event(i, 0, **{m: v}) for i, (m, v) in enumerate(beyond.items(), 1)]
    rows.append(event(9, 0, **{m: None for m in on}))
    row = flat_windows(telemetry(rows), 10).first()
    assert (row["event_count"], row["anomaly_event_count"]) == (6, 4)


def test_metric_without_values_is_zero(telemetry):
    row = flat_windows(telemetry([event(0, packet_loss_percent=None)]), 10).first()
    assert [row[f"packet_loss_percent_{s}"] for s in STATS] == [0.0] * 4


@pytest.mark.parametrize(
    "regions, wanted",
    [(["North", "South"], "North"), ([None, "South"], "South"), (["", "South"], "unknown"), ([None], "unknown"),
     (["unknown", "South"], "unknown")],
)
def test_first_region_of_a_window(telemetry, regions, wanted):
    df = telemetry([event(i, i, region=r) for i, r in enumerate(regions)])
    assert flat_windows(df, 10).first()["region"] == wanted
    assert flat_windows(df, 10, p95="refined").first()["region"] == wanted
    assert window_regions(df, 10).first()["region"] == wanted


def test_empty_windows_do_not_exist(telemetry):
    df = telemetry([event(0, 0), event(1, 35)])
    ends = [r["window_end"] for r in flat_windows(df, 10).orderBy("window_end").collect()]
    assert [(e.replace(tzinfo=dt.timezone.utc) - START).total_seconds() for e in ends] == [10, 40]


def test_documents_have_the_stored_shape(telemetry):
    documents = cell_windows(telemetry([event(0)]))
    assert documents.schema.simpleString() == WINDOW_SCHEMA.simpleString()
    row = documents.first()
    assert (row["window_size_seconds"], row["rolling_window_seconds"]) == (10, 300)
    assert row["latency_ms"].asDict() == {"avg": 20.0, "min": 20.0, "max": 20.0, "p95": 20.0}


def test_slide_must_divide_the_size(telemetry):
    with pytest.raises(ValueError):
        flat_windows(telemetry([event(0)]), 10, slide=3)


def plain_p95(values):
    values = sorted(values)
    return half_up(values[min(19 * len(values) // 20, len(values) - 1)]) if values else None


def test_refined_p95_of_uneven_groups(telemetry, spark):
    """Groups from one row to thousands, with ties, nulls, outliers, a null key and one value only."""
    rng = random.Random(5)
    rows, groups = [], {}
    for cell, n in (("CELL_0001", 1), ("CELL_0002", 20), ("CELL_0003", 21), ("CELL_0004", 400), (None, 3000), ("CELL_0005", 50), ("CELL_0006", 6000)):
        for i in range(n):
            latency = {"CELL_0005": 7.0, "CELL_0004": 1e6 if i == 3 else -i / 8}.get(cell, rng.randrange(-5000, 90_000) / 1000)
            jitter = None if rng.random() < 0.5 else float(rng.randrange(5))
            groups.setdefault(cell, ([], []))[0].append(latency)
            groups[cell][1].append(jitter)
            rows.append(event(len(rows), rng.randrange(8), cell, latency_ms=latency, jitter_ms=jitter))
    df = telemetry(rows)
    expected = {c: (plain_p95(a), plain_p95([x for x in b if x is not None])) for c, (a, b) in groups.items()}
    found = p95_per_group(df, ["cell_id"]).collect()
    assert {r.cell_id: (r.latency_ms_p95, r.jitter_ms_p95) for r in found} == expected
    flat = flat_windows(df, 10).collect()
    assert {r.cell_id: (r.latency_ms_p95, r.jitter_ms_p95) for r in flat} == {c: (a, b or 0.0) for c, (a, b) in expected.items()}


def test_refinement_shuffles_few_rows(spark):
    """Distinct values: per group and metric, the buckets and one bucket's values, not the group's."""
    n = 200_000
    values = {m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**8)) / 1000.0 for i, m in enumerate(FEATURES)}
    rows = spark.range(n).withColumn("cell_id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10)).withColumns(values)
    groups = quantiles.numbered(rows.groupBy("cell_id").agg(*quantiles.ranges(FEATURES)), "test-ranges")
    coarse = quantiles.coarse_counts(rows, groups, ["cell_id"], FEATURES)
    assert coarse.count() <= groups.count() * len(FEATURES) * quantiles.BUCKETS
    chosen = quantiles._rank_buckets(coarse, groups, ["cell_id"], FEATURES)
    assert quantiles.fine_counts(rows, chosen, ["cell_id"], FEATURES).count() < n * len(FEATURES) / 100


def test_small_groups_are_read_once(spark, telemetry):
    """Where every p95 is a maximum, the plan reads the stored windows only."""
    df = telemetry([event(i, 10 * i, latency_ms=float(i)) for i in range(200)])
    plan = flat_windows(df, 10)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1 and "LocalTableScan" not in plan.split("== Physical Plan ==")[1]
