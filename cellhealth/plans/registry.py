"""Query name to ``(spark, sf_dir) -> DataFrame``: each runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import anomaly_share_rule, label_code, label_name
from ..functions.telemetry import cell_name, iso_utc
from ..model import scoring, training
from ..operators import bands, evaluate, events, features, latest, monitor, quantiles, sampling, windows
from ..schemas import FEATURES, GOLDEN_VECTORS, TARGET, WIRE_SCHEMA
from ..sources.telemetry import accepted, decode, keyed_json, rejected, wire_json
from . import tables

DAY = tables.DAY
HOUR = 3600
#: Live lookbacks are minutes; the tables hold days.
STRETCH = DAY // monitor.MINUTE

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- events -------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as JSON messages: every 50th is cut short, every 53rd is a list, every 59th has a
    text for its latency, every 61st one no window could hold, every 67th a time far ahead, and every 41st
    lacks its cell."""
    sent = tables.telemetry(spark, sf_dir)
    known = F.when(F.col("event_id") % 41 != 0, F.col("cell_id"))
    text = wire_json(sent)
    value = (
        F.when(F.col("event_id") % 50 == 0, F.expr("left(value, length(value) - 9)"))
        .when(F.col("event_id") % 53 == 0, F.concat(F.lit("["), "value", F.lit("]")))
        .when(F.col("event_id") % 59 == 0, F.regexp_replace("value", '"latency_ms":[0-9.]+', '"latency_ms":"slow"'))
        .when(F.col("event_id") % 61 == 0, F.regexp_replace("value", '"latency_ms":[0-9.]+', '"latency_ms":1e30'))
        .when(F.col("event_id") % 67 == 0, F.regexp_replace("value", '"timestamp":[0-9.E]+', '"timestamp":1e18'))
        .otherwise(F.col("value"))
    )
    return sent.withColumn("cell_id", known).withColumn("value", text).select("event_id", value.alias("value"))


@query
def parse_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from their JSON messages, the subscriber id and the malformed left out."""
    return accepted(decode(_messages(spark, sf_dir)))


@query
def rejected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that cannot be events."""
    return rejected(decode(_messages(spark, sf_dir))).select("event_id")


@query
def keyed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed sink's messages, their JSON opened again field by field."""
    sent = keyed_json(tables.telemetry(spark, sf_dir))
    opened = F.inline(F.array(F.from_json("value", WIRE_SCHEMA)))
    return sent.select(F.col("key").cast("string").alias("key"), opened)


@query
def anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.anomalies(tables.settled(tables.telemetry(spark, sf_dir))).select("event_id", "cell_id", "ts", *FEATURES)


@query
def rounded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics scaled so that they have decimals to lose."""
    scaled = tables.telemetry(spark, sf_dir).withColumns({m: F.col(m) / 8.0 for m in FEATURES})
    return events.rounded(scaled).select("event_id", *FEATURES)


@query
def clamped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.clamped(tables.telemetry(spark, sf_dir)).select("event_id", *FEATURES)


@query
def peak_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalised_latency(tables.telemetry(spark, sf_dir)).select(
        "event_id", "peak_factor", "normalised_latency_ms"
    )


@query
def id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user id as a cell name, checked along with the subscriber id."""
    checked = events.checked_ids(tables.telemetry(spark, sf_dir))
    return checked.select("event_id", "cell_id", "imsi", "cell_id_ok", "imsi_ok")


@query
def anomaly_archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_archetypes(tables.settled(tables.telemetry(spark, sf_dir))).select("event_id", "archetype")


@query
def archetype_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archetypes of the anomalous events again, by a join with their table of bands."""
    found = events.anomalies(tables.settled(tables.telemetry(spark, sf_dir)))
    return bands.band_join(found, bands.archetype_bands(spark)).select("event_id", "archetype")


@query
def scorable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.scorable(tables.settled(tables.telemetry(spark, sf_dir))).select("event_id", "cell_id", *FEATURES)


# -- windows ------------------------------------------------------------------------------------


def _stats(flat: DataFrame) -> DataFrame:
    return flat.drop("last_ts")


@query
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all statistics per cell and one-day window."""
    return _stats(windows.flat_windows(tables.telemetry(spark, sf_dir), DAY))


@query
def window_stats_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(windows.flat_windows(tables.telemetry(spark, sf_dir), 5 * DAY))


@query
def window_stats_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute windows."""
    return _stats(windows.flat_windows(tables.telemetry(spark, sf_dir), 600))


@query
def sliding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(windows.flat_windows(tables.telemetry(spark, sf_dir), 3 * DAY, slide=DAY))


@query
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a stream: messages that come twice count once, windows go to a table by day."""
    return _stats(tables.streamed_windows(spark, sf_dir)).drop("day")


@query
def streamed_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows as a stream, merged from its panes."""
    return _stats(tables.streamed_windows(spark, sf_dir, DAY, 3 * DAY)).drop("day")


@query
def window_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First region per window, over telemetry whose region is empty or null now and then."""
    region = (
        F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 3 == 1, F.lit(""))
        .otherwise(F.col("region"))
    )
    return windows.window_regions(tables.telemetry(spark, sf_dir).withColumn("region", region), DAY)


@query
def p95_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.p95_per_group(tables.telemetry(spark, sf_dir), ["cell_id"])


@query
def p95_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.p95_approx_per_group(tables.telemetry(spark, sf_dir), ["cell_id"])


@query
def p95_approx_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell, how many values each metric has, and whether the sketched p95 is as near in rank as it promises."""
    accuracy = 10_000
    rows = tables.telemetry(spark, sf_dir)
    sketched = quantiles.p95_approx_per_group(rows, ["cell_id"], accuracy=accuracy)
    ranks = []
    for m in FEATURES:
        value, p = F.col(m), F.col(f"{m}_p95")
        n, below, upto = F.count(m), F.count_if(value < p), F.count_if(value <= p)
        slack = n / accuracy + 1
        ranks += [n.alias(f"{m}_n"), ((below <= 0.95 * n + slack) & (upto >= 0.95 * n - slack)).alias(f"{m}_near")]
    return rows.join(sketched, "cell_id").groupBy("cell_id").agg(*ranks)


@query
def sample_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.bounded_sample(tables.telemetry(spark, sf_dir), ["cell_id"], ["event_id"], cap=100)
    return sample.select("cell_id", "event_id", "latency_ms")


# -- features -----------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.windowed(spark, sf_dir).drop("last_ts")


def _window_rows(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Feature rows of the stored window table."""
    return tables.window_table(spark, sf_dir).drop(*[c for c in ("last_ts", "encoded", "label", "day") if c not in keep])


@query
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored window rows flattened to feature rows."""
    stored = windows.cell_windows(tables.telemetry(spark, sf_dir), DAY)
    return features.feature_rows(stored)


@query
def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_features(_window_rows(spark, sf_dir))


@query
def online_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of the table's first half in time merged with all rows of the second, two days in both."""
    rows = _window_rows(spark, sf_dir)
    newest = monitor.newest_time(rows, "window_end")
    middle = F.timestamp_micros(((F.unix_micros(rows.agg(F.min("window_end")).scalar()) + F.unix_micros(newest)) / 2).cast("bigint"))
    stored = features.latest_features(rows.filter(F.col("window_end") <= middle + F.expr("interval 1 day")))
    fresh = rows.filter(F.col("window_end") > middle - F.expr("interval 1 day"))
    return latest.upsert_latest(stored, fresh, "cell_id", "window_end")


@query
def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features for the cells whose number leaves 3 when divided by 7 and for one unknown, as the reply to a request: read from
    those parts of the online table that they fall into."""
    online = tables.online_table(spark, sf_dir)
    known = online.read().select("cell_id").filter(F.substring("cell_id", 6, 9).cast("int") % 7 == 3)
    asked = known.unionByName(spark.range(1).select(cell_name(F.col("id") + 9999).alias("cell_id")))
    wanted = [f"avg_{m}" for m in FEATURES] + ["event_count", "anomaly_event_count"]
    return online.lookup(asked, columns=wanted)


@query
def feature_store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.store_status(features.latest_features(_window_rows(spark, sf_dir)))


@query
def feature_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each window's last event when the newest event of all came in."""
    rows = tables.window_table(spark, sf_dir)
    last = latest.latest_per_key(rows.select("cell_id", F.col("last_ts").alias("window_end")), "cell_id", "window_end")
    return features.feature_age(last, monitor.newest_time(rows, "last_ts"))


@query
def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the newest feature row of its cell that is less than two days old."""
    moments = tables.telemetry(spark, sf_dir).select("event_id", "cell_id", "ts")
    matched = features.asof_features(moments, _features(spark, sf_dir), ttl_seconds=2 * DAY, bucket_seconds=DAY)
    return matched.select(
        "event_id", "cell_id", "window_end", "avg_latency_ms", "avg_signal_strength_dbm", "event_count"
    )


@query
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


# -- labels -------------------------------------------------------------------------------------


@query
def profile_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.predictions(spark, sf_dir).select("cell_id", "window_end", "encoded", "label")


@query
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes 0 to 4, of which only three have a name."""
    code = (F.col("event_id") % 5).cast("double")
    return tables.telemetry(spark, sf_dir).select("event_id", label_name(code).alias("label"))


@query
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tables.predictions(spark, sf_dir)
    return named.select("cell_id", "window_end", "label", label_code(F.col("label")).alias("code"))


@query
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.telemetry(spark, sf_dir).select("event_id", iso_utc(F.col("ts")).alias("iso"))


@query
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored prediction, its structs opened for comparison."""
    labelled = tables.with_labels(tables.windowed(spark, sf_dir))
    stored = scoring.prediction_rows(labelled.withColumns({m: F.col(f"avg_{m}") for m in FEATURES}), "encoded")
    return stored.select(
        "windowed_metrics_id",
        "window_end",
        "cell_id",
        "region",
        "input_features.*",
        F.col("prediction.encoded").alias("encoded"),
        F.col("prediction.label").alias("label"),
        "event_count",
        "anomaly_event_count",
    )


@query
def window_with_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window rows joined to what was predicted for them."""
    rows, labelled = _stored_tables(spark, sf_dir)
    predicted = labelled.select("cell_id", "window_end", "label")
    joined = rows.join(predicted, ["cell_id", "window_end"])
    return joined.select(scoring.window_id().alias("windowed_metrics_id"), "cell_id", "window_end", "avg_latency_ms", "label")


# -- monitoring ---------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_predictions(tables.window_table(spark, sf_dir))


def _predicted(spark: SparkSession, sf_dir: str):
    """Predictions and their anchor, from the stored table."""
    rows = _predictions(spark, sf_dir)
    return rows, monitor.newest_time(rows, "timestamp")


def _windows(spark: SparkSession, sf_dir: str):
    """Feature rows, with the day they are stored under, and their anchor."""
    rows = _window_rows(spark, sf_dir, "day")
    return rows, monitor.newest_time(rows, "window_end")


def _stored_tables(spark: SparkSession, sf_dir: str):
    """The window table and the predictions on it."""
    return _window_rows(spark, sf_dir, "day"), _predictions(spark, sf_dir)


@query
def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.label_mix(*_predicted(spark, sf_dir), span=20 * DAY)


@query
def labels_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and label: the minutes of a live feed."""
    return monitor.labels_over_time(*_predicted(spark, sf_dir), span=20 * DAY, unit="hour")


@query
def label_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.label_series(*_predicted(spark, sf_dir), span=20 * DAY, unit="hour")


@query
def label_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.label_kpis(*_predicted(spark, sf_dir), span=20 * DAY)


@query
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.region_labels(*_predicted(spark, sf_dir), span=10 * DAY)


@query
def region_health_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.region_shares(*_predicted(spark, sf_dir), span=10 * DAY)


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.class_distribution(_predictions(spark, sf_dir))


@query
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.event_totals(*_windows(spark, sf_dir), span=5 * DAY)


@query
def recent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.recent_count(*_predicted(spark, sf_dir), span=DAY)


@query
def feed_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.feed_active(*_predicted(spark, sf_dir), span=DAY)


@query
def cell_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.cell_latest(_window_rows(spark, sf_dir))


@query
def recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.recent_feed(_predictions(spark, sf_dir), 20)


@query
def cell_label_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.newest_labels(_predictions(spark, sf_dir))


@query
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the telemetry and one that never sent any."""
    windows_table, rows = _stored_tables(spark, sf_dir)
    silent = spark.range(1).select(cell_name(F.col("id") + 9999).alias("cell_id"))
    cells = windows_table.select("cell_id").distinct().unionByName(silent)
    return monitor.cell_grid(cells, rows, windows_table)


@query
def silent_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.silent_cells(_window_rows(spark, sf_dir))


@query
def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total and rate per five minutes."""
    return monitor.event_rate(tables.telemetry(spark, sf_dir), bucket=300)


@query
def filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, anchor = _windows(spark, sf_dir)
    return monitor.filtered(rows, region="ASIA", anchor=anchor, span=10 * DAY).drop("day")


@query
def filtered_cell_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = (F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return monitor.filtered(_window_rows(spark, sf_dir, "day"), cell_id="CELL_0017", window_end=between).drop("day")


@query
def chart_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chart_label_count(_predictions(spark, sf_dir))


@query
def chart_poor_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chart_poor_by_region(_predictions(spark, sf_dir), 5 * DAY)


@query
def chart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chart_events(*_windows(spark, sf_dir), span=10 * DAY)


@query
def chart_signal_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chart_signal_latency(_window_rows(spark, sf_dir))


@query
def chart_region_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    return monitor.chart_region_label(rows, monitor.newest_time(rows, "window_end"), 20 * DAY)


@query
def chart_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.chart_volume(_predictions(spark, sf_dir), 5 * DAY)


@query
def dashboard_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monitoring result in one frame, from one pass over the events."""
    windows_table, rows = _stored_tables(spark, sf_dir)
    anchor = monitor.newest_time(rows, "timestamp")
    return monitor.dashboard_reply(rows, windows_table, anchor, scale=STRETCH, unit="hour")


# -- model --------------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window rows labelled by profile: what the classifier learns from."""
    labelled = tables.window_table(spark, sf_dir)
    return labelled.select(
        "window_end",
        "cell_id",
        "region",
        "event_count",
        *[F.col(f"avg_{m}").alias(m) for m in FEATURES],
        F.col("label").alias(TARGET),
    )


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.stratified_split(_samples(spark, sf_dir), TARGET, ["cell_id", "window_end"])
    return rows.select("cell_id", "window_end", TARGET, "is_test")


@query
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.cross_validation_folds(_samples(spark, sf_dir), TARGET, ["cell_id", "window_end"])
    return rows.select("cell_id", "window_end", TARGET, "fold")


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_weights(_samples(spark, sf_dir), TARGET)


@query
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.standardised(_samples(spark, sf_dir), FEATURES)
    return rows.select("cell_id", "window_end", *FEATURES)


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile labels as truth, the anomaly-share rule as prediction."""
    guess = anomaly_share_rule(F.col("anomaly_event_count"), F.col("event_count"))
    return tables.predictions(spark, sf_dir).withColumn("prediction", guess)


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_ruled(spark, sf_dir))


@query
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quality(evaluate.confusion(_ruled(spark, sf_dir)))


@query
def forest_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest fitted on four fifths of the labelled windows, and how it does on the rest."""
    prepared = training.prepare(_samples(spark, sf_dir))
    held_out = training.predicted_labels(training.fit(prepared), prepared.filter("is_test"))
    return evaluate.confusion(held_out, TARGET, "predicted_label")


@query
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored window scored by a fitted forest, in the stored shape of a prediction."""
    samples = _samples(spark, sf_dir)
    model = training.fit(training.prepare(samples))
    documents = windows.cell_windows(tables.telemetry(spark, sf_dir), DAY)
    return scoring.score(model, documents).drop("timestamp")


@query
def forest_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored predictions of ``forest_predictions`` by their parts that do not hang on the forest's draws: ids, inputs and counts,
    whether the code stands for the label, and whether nine in ten of all labels are those of the profile labeller."""
    found = forest_predictions(spark, sf_dir)
    known = tables.window_table(spark, sf_dir).select(scoring.window_id().alias("windowed_metrics_id"), F.col("label").alias("known"))
    rows = found.join(known, "windowed_metrics_id")
    agreed = rows.agg((F.avg((F.col("prediction.label") == F.col("known")).cast("double")) >= 0.9).alias("agreed")).scalar()
    code = label_code(F.col("prediction.label"))
    return rows.select(
        "windowed_metrics_id",
        "window_end",
        "cell_id",
        "region",
        "input_features.*",
        "event_count",
        "anomaly_event_count",
        code.isNotNull().alias("has_label"),
        agreed.alias("agreed"),
    )


@query
def forest_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class, the rows held out and whether a fitted forest names nine in ten of them right."""
    prepared = training.prepare(_samples(spark, sf_dir))
    held_out = training.predicted_labels(training.fit(prepared), prepared.filter("is_test"))
    right = F.count_if(F.col(TARGET) == F.col("predicted_label"))
    return held_out.groupBy(TARGET).agg(F.count("*").alias("held_out"), (right >= 0.9 * F.count("*")).alias("accurate"))


@query
def forest_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forest fitted on the labelled windows says of the golden vectors."""
    model = training.fit(training.prepare(_samples(spark, sf_dir)))
    golden = spark.createDataFrame([v for v, _ in GOLDEN_VECTORS], list(FEATURES))
    return training.predicted_labels(model, golden).select("latency_ms", F.col("predicted_label").alias("label"))


@query
def forest_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold of the training part, its rows, and whether cross-validation is right nine times in ten."""
    prepared = training.prepare(_samples(spark, sf_dir))
    _, accuracy = training.cross_validated(prepared, trees=20)
    folds = prepared.filter(~F.col("is_test")).groupBy("fold").agg(F.count("*").alias("rows"))
    return folds.withColumn("accurate", F.lit(accuracy) >= 0.9)
