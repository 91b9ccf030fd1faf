"""Per-cell time windows: counts, anomalies, first region and {avg, min, max, p95} per metric."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MILLI, average_of, half_up, sum_milli, to_milli
from ..functions.telemetry import is_anomaly, known_or_default
from ..schemas import FEATURES, STATS
from ..session import stored_table
from .quantiles import merged_sketch, numbered, p95_aggregate, p95_of_sketch, p95_sketch, with_p95

# Emission interval, and the constant the window rows carry beside it.
WINDOW_SECONDS = 10
ROLLING_SECONDS = 300

_GROUP = ("window", "cell_id")


def _earliest(region_time: str) -> Column:
    """Least (time, region) among the rows that have a region: fixes what "first" means on ties."""
    return F.min(F.when(F.col("region").isNotNull(), F.struct(region_time, "region")))


def _partials(stats: Sequence[str], metrics: Sequence[str]) -> list[Column]:
    """Aggregates that can be merged again; all fixed-width, so Spark keeps them in a hash map."""
    aggregates = [
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(is_anomaly()).alias("anomaly_event_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ]
    for m in metrics:
        if "avg" in stats:
            aggregates += [sum_milli(F.col(m)).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
        if "min" in stats:
            aggregates.append(F.min(m).alias(f"{m}_min"))
        if "max" in stats:
            aggregates.append(F.max(m).alias(f"{m}_max"))
    return aggregates


def _merged(stats: Sequence[str], metrics: Sequence[str]) -> list[Column]:
    """The same aggregates over partial rows instead of events."""
    aggregates = [
        F.sum("event_count").alias("event_count"),
        F.sum("anomaly_event_count").alias("anomaly_event_count"),
        F.max("last_ts").alias("last_ts"),
        _earliest("first_ts").alias("first"),
    ]
    for m in metrics:
        if "avg" in stats:
            aggregates += [F.sum(f"{m}_sum").alias(f"{m}_sum"), F.sum(f"{m}_n").alias(f"{m}_n")]
        if "min" in stats:
            aggregates.append(F.min(f"{m}_min").alias(f"{m}_min"))
        if "max" in stats:
            aggregates.append(F.max(f"{m}_max").alias(f"{m}_max"))
    return aggregates


def _finished(stats: Sequence[str], metrics: Sequence[str]) -> list[Column]:
    """Flat ``<metric>_<stat>`` columns; 0 where the metric had no values in the window."""
    columns = []
    for m in metrics:
        for stat in stats:
            if stat == "avg":
                value = average_of(F.col(f"{m}_sum"), F.col(f"{m}_n"))
            else:
                value = F.coalesce(half_up(F.col(f"{m}_{stat}")), F.lit(0.0))
            columns.append(value.alias(f"{m}_{stat}"))
    return columns


def _seconds(n: int) -> str:
    return f"{n} seconds"


def _starts(pane: Column, size: int, slide: int) -> Column:
    """Starts of the windows a pane lies in: size / slide of them for each pre-aggregated pane."""
    step = F.expr(f"interval {slide} seconds")
    return F.sequence(pane - F.expr(f"interval {size - slide} seconds"), pane, step)


def _window(start: Column, size: int) -> Column:
    return F.struct(start.alias("start"), (start + F.expr(f"interval {size} seconds")).alias("end"))


def _windows_by_hash(keyed: DataFrame, size: int, slide: int, stats: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Statistics without p95, merged from partial rows per (window, cell, region).

    A text in an aggregate would turn hashing into sorting; as a key it does not, and a cell has
    one region or few.
    """
    partial = keyed.groupBy(*_GROUP, "region").agg(*_partials(stats, metrics))
    if slide != size:
        start = F.explode(_starts(F.col("window.start"), size, slide))
        partial = partial.withColumn("start", start).withColumn("window", _window(F.col("start"), size))
    return partial.groupBy(*_GROUP).agg(*_merged(stats, metrics))


def _windows_by_refinement(keyed: DataFrame, size: int, slide: int, metrics: Sequence[str]) -> DataFrame:
    """All statistics: those of ``_windows_by_hash`` as a stored table, and exact p95s refined from their counts and ranges."""
    stats = _windows_by_hash(keyed, size, slide, ("avg", "min", "max"), metrics)
    start = F.col("window.start") if slide == size else F.explode(_starts(F.col("window.start"), size, slide))
    return _refined(stats, keyed.select(start.alias("start"), "cell_id", *metrics), metrics)


def _refined(stats: DataFrame, rows: DataFrame, metrics: Sequence[str], weight: str | None = None) -> DataFrame:
    """The windows of ``stats``, stored, with exact p95s of ``rows`` (start, cell_id, metrics)."""
    stats = stats.withColumn("start", F.col("window.start"))
    bounds = {f"{m}_{name}": to_milli(F.col(f"{m}_{side}")) for m in metrics for name, side in (("low", "min"), ("high", "max"))}
    stats = numbered(stats.withColumns(bounds), "window-ranges")
    exact = with_p95(stats, rows, ["start", "cell_id"], metrics, weight=weight)
    return exact.withColumns({f"{m}_p95": F.col(f"{m}_p95") / MILLI for m in metrics})


def _windows_of_stream(keyed: DataFrame, size: int, slide: int, stats: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One aggregation a pane, with a sketch for each p95; sliding windows by a second one over the panes that closed.

    So an event touches one state entry, not one for each window it lies in, and an entry's size does not follow its events.
    """
    sketched = metrics if "p95" in stats else ()
    sketches = [p95_sketch(m).alias(f"{m}_sketch") for m in sketched]
    windows = keyed.groupBy(*_GROUP).agg(*_partials(stats, metrics), _earliest("ts").alias("first"), *sketches)
    if slide != size:
        panes = windows.withColumn("pane", F.window_time("window")).drop("window")
        merged = [*_merged(stats, metrics)[:3], F.min("first").alias("first"), *_merged(stats, metrics)[4:]]
        merged += [merged_sketch(f"{m}_sketch").alias(f"{m}_sketch") for m in sketched]
        windows = panes.groupBy(F.window("pane", _seconds(size), _seconds(slide)), "cell_id").agg(*merged)
    return windows.withColumns({f"{m}_p95": p95_of_sketch(f"{m}_sketch") / MILLI for m in sketched}) if sketched else windows


def counted_windows(events: DataFrame, size: int = WINDOW_SECONDS, slide: int | None = None, metrics: Sequence[str] = FEATURES) -> DataFrame:
    """What ``windows_of_counts`` makes windows of: counts that a stream keeps of each cell's values in a window.

    A row per window, cell, metric (its place) and thousandth, and one per region for the events themselves (place -1). Entries of the state
    have a fixed width, a window's are spread over all tasks, and repeated values share one. The stream needs its watermark; all rows
    of a window leave together when it passes the window's end. Sliding windows are merged from closed panes.
    """
    slide = slide or size
    if size % slide:
        raise ValueError("the slide must divide the window size")

    def entry(place: int, milli: Column, region: Column, odd: Column) -> Column:
        return F.struct(F.lit(place).alias("metric"), milli.alias("milli"), region.alias("region"), odd.alias("odd"))

    none = F.lit(None).cast("string")
    entries = [entry(-1, F.lit(0).cast("long"), F.col("region"), is_anomaly())]
    entries += [entry(i, to_milli(F.col(m)), none, F.lit(False)) for i, m in enumerate(metrics)]
    keyed = events.withColumn("window", F.window("ts", _seconds(slide)))
    rows = keyed.select(*_GROUP, "ts", F.inline(F.array(*entries))).filter("milli is not null")
    keys = ["cell_id", "metric", "milli", "region"]
    counts = rows.groupBy("window", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("anomalies"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    if slide == size:
        return counts
    panes = counts.withColumn("pane", F.window_time("window")).drop("window")
    merged = [f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "anomalies"), (F.min, "first_ts"), (F.max, "last_ts"))]
    return panes.groupBy(F.window("pane", _seconds(size), _seconds(slide)), *keys).agg(*merged)


def windows_of_counts(counts: DataFrame, metrics: Sequence[str] = FEATURES) -> DataFrame:
    """Flat window rows, p95 exact, from whole windows of ``counted_windows``: a batch that a stream hands on, stored first because it
    is read several times."""
    counts = stored_table(counts, "counted-windows")
    times = lambda i, x=1: F.sum(F.when(F.col("metric") == i, F.col("n") * x).otherwise(0))
    of = lambda f, i: f(F.when(F.col("metric") == i, F.col("milli") / MILLI))
    aggregates = [times(-1).alias("event_count"), F.sum("anomalies").alias("anomaly_event_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]
    for i, m in enumerate(metrics):
        aggregates += [times(i, F.col("milli")).alias(f"{m}_sum"), times(i).alias(f"{m}_n"), of(F.min, i).alias(f"{m}_min"), of(F.max, i).alias(f"{m}_max")]
    # As in _windows_by_hash: the region is a key first, for a text in an aggregate would turn hashing into sorting.
    stats = counts.groupBy(*_GROUP, "region").agg(*aggregates).groupBy(*_GROUP).agg(*_merged(("avg", "min", "max"), metrics))
    values = [F.when(F.col("metric") == i, F.col("milli") / MILLI).alias(m) for i, m in enumerate(metrics)]
    rows = counts.filter("metric >= 0").select(F.col("window.start").alias("start"), "cell_id", "n", *values)
    return _flat(_refined(stats, rows, metrics, "n"), STATS, metrics)


def flat_windows(
    events: DataFrame,
    size: int = WINDOW_SECONDS,
    slide: int | None = None,
    stats: Sequence[str] = STATS,
    metrics: Sequence[str] = FEATURES,
    p95: str | None = None,
) -> DataFrame:
    """Window rows with flat ``<metric>_<stat>`` columns, from a static or a streaming DataFrame.

    ``size`` and ``slide`` are seconds; windows are aligned to the epoch. Events are aggregated
    before the shuffle, sliding windows are merged from panes of one slide. ``p95`` says how:

    * ``"refined"``, the choice for tables: exact, for groups of any size; the other statistics are stored on the way, so a job
      runs at once.
    * ``"sketch"``, the choice for streams and for them only: state of bounded size, exact for windows of up to some hundred
      values a metric, else with the sketch's rank error. Streams get exact ones of any size by ``counted_windows``.
    * ``"aggregate"``: exact, in the one aggregation, whose buffer holds a count per distinct value; not for sliding windows.

    A stream needs its watermark set by the caller.
    """
    slide = slide or size
    p95 = p95 or ("sketch" if events.isStreaming else "refined")
    if size % slide:
        raise ValueError("the slide must divide the window size")
    if p95 not in ("sketch", "aggregate") if events.isStreaming else p95 not in ("refined", "aggregate"):
        raise ValueError(f"no p95 by {p95} here")
    if slide != size and "p95" in stats and p95 == "aggregate":
        raise ValueError("sliding windows merge panes, and an aggregated p95 cannot be merged")

    keyed = events.withColumn("window", F.window("ts", _seconds(slide)))
    if "p95" in stats and p95 == "aggregate":
        aggregates = [*_partials(stats, metrics), _earliest("ts").alias("first")]
        windows = keyed.groupBy(*_GROUP).agg(*aggregates, *[p95_aggregate(m).alias(f"{m}_p95") for m in metrics])
    elif events.isStreaming:
        windows = _windows_of_stream(keyed, size, slide, stats, metrics)
    elif "p95" in stats:
        windows = _windows_by_refinement(keyed, size, slide, metrics)
    else:
        windows = _windows_by_hash(keyed, size, slide, stats, metrics)

    return _flat(windows, stats, metrics)


def _flat(windows: DataFrame, stats: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return windows.select(
        "cell_id",
        F.col("window.end").alias("window_end"),
        "last_ts",
        known_or_default(F.col("first.region")).alias("region"),
        "event_count",
        "anomaly_event_count",
        *_finished(stats, metrics),
    )


def to_documents(flat: DataFrame, size: int = WINDOW_SECONDS, metrics: Sequence[str] = FEATURES) -> DataFrame:
    """Window rows in the stored shape: one struct of statistics per metric."""
    return flat.select(
        "window_end",
        F.lit(size).alias("window_size_seconds"),
        F.lit(ROLLING_SECONDS).alias("rolling_window_seconds"),
        "cell_id",
        "region",
        "event_count",
        "anomaly_event_count",
        *[F.struct(*[F.col(f"{m}_{s}").alias(s) for s in STATS]).alias(m) for m in metrics],
        F.current_timestamp().alias("ingested_at"),
    )


def cell_windows(
    events: DataFrame, size: int = WINDOW_SECONDS, slide: int | None = None, p95: str | None = None
) -> DataFrame:
    """The window table: one stored row per cell and window that saw an event."""
    return to_documents(flat_windows(events, size, slide, p95=p95), size)


def metric_value(df: DataFrame, metric: str) -> Column:
    """A metric that is stored either as a struct of statistics or as a plain number."""
    if df.schema[metric].dataType.typeName() == "struct":
        return F.col(f"{metric}.avg")
    return F.col(metric)


def has_all_metrics(df: DataFrame, metrics: Sequence[str] = FEATURES) -> Column:
    return reduce(lambda a, b: a & b, [metric_value(df, m).isNotNull() for m in metrics])


def window_regions(events: DataFrame, size: int = WINDOW_SECONDS) -> DataFrame:
    """Region of each cell's window: that of its earliest event that has one."""
    return (
        events.withColumn("window", F.window("ts", _seconds(size)))
        .groupBy(*_GROUP, "region")
        .agg(F.min("ts").alias("first_ts"))
        .groupBy(*_GROUP)
        .agg(_earliest("first_ts").alias("first"))
        .select(
            "cell_id",
            F.col("window.end").alias("window_end"),
            known_or_default(F.col("first.region")).alias("region"),
        )
    )


def as_features(flat: DataFrame, metrics: Sequence[str] = FEATURES) -> DataFrame:
    """Flat window rows with their averages named as the feature table names them."""
    return flat.select(
        "cell_id",
        "window_end",
        "last_ts",
        "region",
        "event_count",
        "anomaly_event_count",
        *[F.col(f"{m}_avg").alias(f"avg_{m}") for m in metrics],
    )
