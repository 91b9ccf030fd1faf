"""Monitoring queries over the window and prediction tables.

Lookbacks have no upper bound and take their anchor as a column, so a reply uses one "now"
throughout. Spans are seconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, percent
from ..functions.telemetry import bin_start, iso_utc
from ..schemas import LABELS, UNKNOWN
from .latest import latest_per_key, newest_rows

MINUTE = 60
DAY = 86_400
FEED_ROWS = 20


def newest_time(df: DataFrame, column: str) -> Column:
    """The table's newest time as a scalar subquery: an anchor for data that is not live."""
    return df.agg(F.max(column)).scalar()


def since(df: DataFrame, column: str, anchor: Column, span: int) -> DataFrame:
    """Rows from ``span`` before the anchor on.

    A stored table's ``day`` is the date its rows' windows end, never before any of their times, so it
    tells which days need not be read.
    """
    low = anchor - F.expr(f"interval {span} seconds")
    if "day" in df.columns:
        df = df.filter(F.col("day") >= F.to_date(low))
    return df.filter(F.col(column) >= low)


# -- labels -------------------------------------------------------------------------------------


def label_counts(predictions: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Predictions per label, within further groups if any."""
    return predictions.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("count"))


def label_mix(predictions: DataFrame, anchor: Column, span: int = 30 * MINUTE) -> DataFrame:
    return label_counts(since(predictions, "timestamp", anchor, span))


def labels_over_time(
    predictions: DataFrame, anchor: Column, span: int = 30 * MINUTE, unit: str = "minute"
) -> DataFrame:
    at = F.date_trunc(unit, "timestamp").alias("bucket")
    return label_counts(since(predictions, "timestamp", anchor, span), [at]).orderBy("bucket", "label")


def label_series(
    predictions: DataFrame, anchor: Column, span: int = 30 * MINUTE, unit: str = "minute"
) -> DataFrame:
    """One row per time unit with a zero-filled column per label, and one for any other label."""
    columns = [F.count_if(F.col("label") == label).alias(label) for label in LABELS]
    other = F.count_if(F.coalesce(~F.col("label").isin(*LABELS), F.lit(True))).alias("other")
    recent = since(predictions, "timestamp", anchor, span)
    return recent.groupBy(F.date_trunc(unit, "timestamp").alias("bucket")).agg(*columns, other).orderBy("bucket")


def label_kpis(predictions: DataFrame, anchor: Column, span: int = 30 * MINUTE) -> DataFrame:
    """A count for every known label, 0 where none was predicted."""
    recent = since(predictions, "timestamp", anchor, span)
    totals = recent.agg(*[F.count_if(F.col("label") == label).alias(label) for label in LABELS])
    return totals.unpivot([], list(LABELS), "label", "count")


def region_labels(predictions: DataFrame, anchor: Column, span: int = 10 * MINUTE) -> DataFrame:
    return label_counts(since(predictions, "timestamp", anchor, span), ["region"])


def region_shares(predictions: DataFrame, anchor: Column, span: int = 10 * MINUTE) -> DataFrame:
    """Share of each known label per region in percent; regions without one are left out."""
    recent = since(predictions, "timestamp", anchor, span)
    counts = recent.groupBy("region").agg(*[F.count_if(F.col("label") == label).alias(label) for label in LABELS])
    total = sum((F.col(label) for label in LABELS[1:]), F.col(LABELS[0]))
    shares = [percent(F.col(label), F.col("total")).alias(f"{label}_pct") for label in LABELS]
    return counts.withColumn("total", total).filter("total > 0").select("region", *shares).orderBy("region")


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage per class; the total is taken over the few class rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("pct", percent(F.col("count"), total))


# -- events and cells ---------------------------------------------------------------------------


def event_totals(windows: DataFrame, anchor: Column, span: int = 5 * MINUTE) -> DataFrame:
    """Events and window rows of the span; one row even on no input."""
    return since(windows, "window_end", anchor, span).agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"),
        F.count(F.lit(1)).alias("total_docs"),
    )


def recent_count(predictions: DataFrame, anchor: Column, span: int = MINUTE) -> DataFrame:
    return since(predictions, "timestamp", anchor, span).agg(F.count(F.lit(1)).alias("predictions"))


def feed_active(predictions: DataFrame, anchor: Column, span: int = MINUTE) -> DataFrame:
    return recent_count(predictions, anchor, span).select((F.col("predictions") > 0).alias("active"))


def cell_latest(features: DataFrame) -> DataFrame:
    """Newest state of each cell, by cell."""
    newest = latest_per_key(
        features.select(
            "cell_id",
            F.col("window_end").alias("last_seen"),
            "region",
            F.col("avg_signal_strength_dbm").alias("signal_avg"),
            F.col("avg_latency_ms").alias("latency_avg"),
            F.col("avg_throughput_mbps").alias("throughput_avg"),
        ),
        "cell_id",
        "last_seen",
    )
    return newest.orderBy("cell_id")


def recent_feed(predictions: DataFrame, n: int = FEED_ROWS) -> DataFrame:
    """The newest predictions, as the feed shows them."""
    rows = predictions.select("cell_id", "region", "label", "timestamp")
    return newest_rows(rows, "timestamp", ["cell_id"], n)


def newest_labels(predictions: DataFrame) -> DataFrame:
    """Newest label of each cell that has a prediction."""
    newest = latest_per_key(predictions.select("cell_id", "timestamp", "label"), "cell_id", "timestamp")
    return newest.select("cell_id", F.coalesce("label", F.lit(UNKNOWN)).alias("label"))


def cell_grid(cells: DataFrame, predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Every known cell with its newest label, ``unknown`` by default, and its newest state."""
    return (
        cells.join(newest_labels(predictions), "cell_id", "left")
        .join(cell_latest(features), "cell_id", "left")
        .select(
            "cell_id",
            F.coalesce("label", F.lit(UNKNOWN)).alias("label"),
            "region",
            half_up(F.col("signal_avg"), 1).alias("signal_avg"),
            half_up(F.col("latency_avg"), 1).alias("latency_avg"),
        )
    )


def _steps(low: Column, high: Column, seconds: int) -> Column:
    return F.sequence(low, high, F.expr(f"interval {seconds} seconds"))


def silent_cells(windows: DataFrame, step: int = DAY, piece: int = 512) -> DataFrame:
    """Cells and window ends between the table's first and last without a window row.

    Time is cut into pieces of ``piece`` windows. The ends a cell has in a piece, never more than that many,
    are gathered and taken from the piece's ends, so only silent ones become rows.
    """
    second = F.unix_seconds("window_end")
    first, last = (windows.agg(f(second)).scalar() for f in (F.min, F.max))
    number = F.floor((second - first) / (step * piece))
    seen = windows.groupBy("cell_id", number.alias("piece")).agg(F.collect_set(second).alias("seen"))
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((last - first) / (step * piece))))
    grid = windows.select("cell_id").distinct().withColumn("piece", pieces)
    low = first + F.col("piece") * F.lit(step * piece)
    ends = F.sequence(low, F.least(low + F.lit(step * (piece - 1)), last), F.lit(step).cast("bigint"))
    silent = F.array_except(ends, F.coalesce("seen", F.array().cast("array<bigint>")))
    found = grid.join(seen, ["cell_id", "piece"], "left").select("cell_id", F.explode(silent).alias("at"))
    return found.select("cell_id", F.timestamp_seconds("at").alias("window_end"))


def event_rate(events: DataFrame, bucket: int = 5) -> DataFrame:
    """Running total and rate per second for every bucket from the first event to the last.

    Running totals are built in two levels, days and buckets within a day, so that no task orders
    more than one day of buckets; only the list of days is ordered as a whole.
    """
    if DAY % bucket:
        raise ValueError("the bucket must divide a day")
    counts = events.groupBy(bin_start(F.col("ts"), bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    day_of = F.date_trunc("day", "bucket")
    day_counts = counts.groupBy(day_of.alias("day")).agg(
        F.sum("n").alias("day_n"), F.min("bucket").alias("first"), F.max("bucket").alias("last")
    )
    in_order = Window.orderBy("day")
    following = F.lead("day").over(in_order)
    offsets = day_counts.select(
        "day",
        F.coalesce(F.sum("day_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.when(F.lag("day").over(in_order).isNull(), F.col("first")).otherwise(F.col("day")).alias("start"),
        F.coalesce(following - F.expr(f"interval {bucket} seconds"), "last").alias("end"),
    )
    # A day's rows run to the next day that has events, so silent days are filled as well; they are made
    # day by day, so an array holds one day's buckets however long the gap.
    one_day = F.expr("interval 1 day")
    ahead = F.explode(F.sequence(F.col("day"), F.date_trunc("day", "end"), one_day))
    days = offsets.withColumn("at", ahead)
    low = F.greatest("start", "at")
    high = F.least("end", F.col("at") + one_day - F.expr(f"interval {bucket} seconds"))
    grid = days.withColumn("bucket", F.explode(_steps(low, high, bucket)))
    within_day = Window.partitionBy("day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(
        "bucket",
        (F.col("before") + F.sum("n").over(within_day)).alias("total"),
        (F.col("n") / float(bucket)).alias("events_per_second"),
    )


# -- charts -------------------------------------------------------------------------------------


def chart_label_count(predictions: DataFrame) -> DataFrame:
    return label_counts(predictions)


def chart_poor_by_region(predictions: DataFrame, bin_seconds: int = 5 * MINUTE) -> DataFrame:
    at = bin_start(F.col("window_end"), bin_seconds).alias("bucket")
    poor = predictions.filter(F.col("label") == "poor")
    return poor.groupBy(at, "region").agg(F.count(F.lit(1)).alias("count"))


def chart_events(windows: DataFrame, anchor: Column, span: int = 10 * MINUTE) -> DataFrame:
    return since(windows, "window_end", anchor, span).agg(F.sum("event_count").alias("events"))


def chart_signal_latency(features: DataFrame) -> DataFrame:
    return features.select(
        F.col("avg_signal_strength_dbm").alias("signal"),
        F.col("avg_latency_ms").alias("latency"),
        "region",
        "cell_id",
    )


def chart_region_label(predictions: DataFrame, anchor: Column, span: int = 30 * MINUTE) -> DataFrame:
    return label_counts(since(predictions, "window_end", anchor, span), ["region"])


def chart_volume(predictions: DataFrame, bin_seconds: int = 5 * MINUTE) -> DataFrame:
    return label_counts(predictions, [bin_start(F.col("timestamp"), bin_seconds).alias("bucket")])


def filtered(
    rows: DataFrame,
    region: str | None = None,
    cell_id: str | None = None,
    window_end: tuple[datetime | Column, datetime | Column] | None = None,
    anchor: Column | None = None,
    span: int = 60 * MINUTE,
) -> DataFrame:
    """The chart filters: region, cell, and a window-end range that defaults to the last hour."""
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    if cell_id is not None:
        rows = rows.filter(F.col("cell_id") == cell_id)
    if window_end is not None:
        if "day" in rows.columns:
            rows = rows.filter(F.col("day").between(*[F.to_date(F.lit(t)) for t in window_end]))
        return rows.filter(F.col("window_end").between(*window_end))
    return since(rows, "window_end", F.current_timestamp() if anchor is None else anchor, span)


# -- the composite reply ------------------------------------------------------------------------


def _item(section: str, key: Column, *fields: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("item"))


def _one_more(rows: DataFrame) -> DataFrame:
    """The rows, marked ``real``, and a row without values that is not: totals then have a row on no input too."""
    blank = rows.sparkSession.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes], F.lit(False).alias("real"))
    return rows.withColumn("real", F.lit(True)).unionByName(blank)


def _prediction_items(predictions: DataFrame, anchor: Column, minutes: int, unit: str) -> DataFrame:
    """Mix, rate, activity, regions and series from one scan: the longest lookback is read, and each figure counts its own."""
    at = F.date_trunc(unit, "timestamp").alias("bucket")
    recent = _one_more(since(predictions, "timestamp", anchor, 30 * minutes).select("region", "label", "timestamp", at))
    within = lambda span: F.count_if(F.col("real") & (F.col("timestamp") >= anchor - F.expr(f"interval {span} seconds")))
    other = F.coalesce(~F.col("label").isin(*LABELS), F.lit(True))
    keys = ("region", "label", "bucket")
    counts = recent.groupingSets([["label"], ["region", "label"], ["bucket"], []], *keys).agg(
        F.grouping_id(*keys).alias("left_out"),
        F.count_if("real").alias("half_hour"),
        within(10 * minutes).alias("ten_minutes"),
        within(minutes).alias("minute"),
        *[F.count_if(F.col("real") & (F.col("label") == label)).alias(f"is_{label}") for label in LABELS],
        F.count_if(F.col("real") & other).alias("is_other"),
    )
    left_out, number = F.col("left_out"), F.col("half_hour").alias("count")
    series = [F.col(f"is_{label}").alias(label) for label in (*LABELS, "other")]
    regions = (F.col("region"), F.col("label"), F.col("ten_minutes").alias("count"))
    # A bit of ``left_out`` is set for each key that a row's grouping set lacks.
    items = (
        F.when((left_out == 0b101) & (F.col("half_hour") > 0), F.array(_item("distribution", F.col("label"), number)))
        .when((left_out == 0b001) & (F.col("ten_minutes") > 0), F.array(_item("regions", F.concat_ws(" ", "region", "label"), *regions)))
        .when((left_out == 0b110) & (F.col("half_hour") > 0), F.array(_item("series", iso_utc(F.col("bucket")), *series)))
        .when(
            left_out == 0b111,
            F.array(
                _item("rate", F.lit(""), F.col("minute").alias("predictions")), _item("active", F.lit(""), (F.col("minute") > 0).alias("active"))
            ),
        )
    )
    return counts.select(F.inline(items))


def _feature_items(features: DataFrame, anchor: Column, span: int) -> DataFrame:
    """The newest state of each cell and the totals of the span, from one scan and a second step over one row a cell."""
    recent = F.col("window_end") >= anchor - F.expr(f"interval {span} seconds")
    state = {"region": "region", "avg_signal_strength_dbm": "signal_avg", "avg_latency_ms": "latency_avg", "avg_throughput_mbps": "throughput_avg"}
    newest = F.max(F.struct(F.col("window_end").alias("last_seen"), *[F.col(c).alias(name) for c, name in state.items()]))
    cells = features.groupBy("cell_id").agg(newest.alias("newest"), F.sum(F.when(recent, F.col("event_count"))).alias("events"), F.count_if(recent).alias("docs"))
    both = (
        _one_more(cells)
        .groupingSets([["cell_id"], []], "cell_id")
        .agg(F.grouping_id("cell_id").alias("all"), F.max("real").alias("real"), F.max("newest").alias("newest"), F.sum("events").alias("events"), F.sum("docs").alias("docs"))
    )
    shown = [F.col(f"newest.{name}").alias(name) for name in state.values()]
    totals = (F.coalesce("events", F.lit(0)).alias("total_events"), F.coalesce("docs", F.lit(0)).alias("total_docs"))
    cell = _item("cells", F.col("cell_id"), *shown, iso_utc(F.col("newest.last_seen")).alias("last_seen"))
    items = F.when(F.col("all") == 1, F.array(_item("events", F.lit(""), *totals))).when(F.col("real"), F.array(cell))
    return both.select(F.inline(items))


def dashboard_reply(
    predictions: DataFrame, features: DataFrame, anchor: Column, scale: int = 1, unit: str = "minute"
) -> DataFrame:
    """All monitoring results in one frame: a section, a key within it, and the item as JSON.

    One row per item rather than one document, so the reply may hold any number of cells.
    ``scale`` stretches every lookback alike. Three scans: recent predictions, the newest ones, and the features.
    """
    # The text is made below the limit: made above it, it would turn the top-n into a full sort.
    stamped = predictions.select("cell_id", "region", "label", "timestamp", iso_utc(F.col("timestamp")).alias("iso"))
    feed = newest_rows(stamped, "timestamp", ["cell_id"], FEED_ROWS)
    recent = _item("recent", F.concat_ws(" ", "iso", "cell_id"), F.col("cell_id"), F.col("region"), F.col("label"), F.col("iso").alias("timestamp"))
    return (
        _prediction_items(predictions, anchor, MINUTE * scale, unit)
        .unionByName(_feature_items(features, anchor, 5 * MINUTE * scale))
        .unionByName(feed.select(F.inline(F.array(recent))))
    )
