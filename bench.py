"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run whole into a sink that discards rows: one warm-up, then the median of
``$BENCH_RUNS`` runs. ``value`` is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from cellhealth.model import training
from cellhealth.operators.windows import flat_windows
from cellhealth.plans import registry, tables
from cellhealth.schemas import FEATURES, TARGET, TELEMETRY_SCHEMA
from cellhealth.session import local_session
from cellhealth.streaming import queries as streams

HEADLINE = (
    "parse_telemetry",
    "anomaly_archetype",
    "window_stats",
    "window_stats_narrow",
    "sliding_stats",
    "p95_exact",
    "p95_approx",
    "sample_per_cell",
    "latest_features",
    "feature_lookup",
    "asof_features",
    "label_series",
    "region_health_pct",
    "recent_feed",
    "cell_grid",
    "event_rate",
    "dashboard_reply",
    "stratified_split",
    "weighted_metrics",
    "forest_confusion",
)
ONCE = {"forest_confusion"}


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def ten_seconds(spark, sf_dir: str):
    """The default window width, over the whole table."""
    return flat_windows(tables.telemetry(spark, sf_dir), 10)


def fitted(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of one fit and of scoring every stored window with it, apart."""
    samples = tables.window_table(spark, sf_dir).select(*[F.col(f"avg_{m}").alias(m) for m in FEATURES], F.col("label").alias(TARGET), "cell_id", "window_end")
    prepared = training.prepare(samples)
    model = None

    def fit():
        nonlocal model
        model = training.fit(prepared)

    return {"forest_fit": seconds(fit), "forest_score": seconds(lambda: discard(training.predicted_labels(model, samples)))}


def replay(spark, sf_dir: str, work: str, once: bool) -> tuple[float, int]:
    """Windows over a stream of time-ordered files, with or without the guard against doubled messages: seconds, and the most rows
    that the window state held."""
    root = f"{work}/{'once' if once else 'plain'}"
    events = tables.telemetry(spark, sf_dir).select(*TELEMETRY_SCHEMA.names)
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/events")
    stream = spark.readStream.schema(TELEMETRY_SCHEMA).parquet(f"{root}/events")
    windows = streams.window_stream(stream, tables.DAY, lateness="1 hour", once=once)
    query = streams.append_to_table(windows, f"{root}/windows", f"{root}/checkpoint")
    took = seconds(query.awaitTermination)
    # The window operator is listed first, as it comes last in the plan.
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return took, max(states, default=0)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false"})
    known = registry.queries()
    times = {}
    for name in chosen:
        build = known[name]
        if name in ONCE:
            times[name] = seconds(lambda: discard(build(spark, sf_dir)))
            continue
        discard(build(spark, sf_dir))
        times[name] = statistics.median(seconds(lambda: discard(build(spark, sf_dir))) for _ in range(runs))
    if "BENCH_QUERIES" not in os.environ:
        discard(ten_seconds(spark, sf_dir))
        times["windows_10s"] = statistics.median(seconds(lambda: discard(ten_seconds(spark, sf_dir))) for _ in range(runs))
        times |= fitted(spark, sf_dir)
    n_events = tables.table(spark, sf_dir, "events").count()
    with tempfile.TemporaryDirectory(prefix="bench-") as work:
        took, state_rows = replay(spark, sf_dir, work, once=False)
        times["stream_replay_once"] = replay(spark, sf_dir, work, once=True)[0]
    times["stream_replay"] = took
    report = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": n_events,
        "stream_events_per_second": round(n_events / took),
        "stream_state_rows": state_rows,
        "cpus": int(cpus),
        "runs": runs,
        "spark": spark.version,
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
