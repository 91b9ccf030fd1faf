"""The feature table: rows, lookup, point-in-time join, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.telemetry import FRESH_SECONDS, age_seconds, age_text, known_or_default
from ..schemas import CELL_FEATURES, FEATURES, UNKNOWN, FeatureView
from .latest import latest_per_key
from .windows import WINDOW_SECONDS, metric_value

_MICROS = 1_000_000


def feature_rows(windows: DataFrame) -> DataFrame:
    """Window rows as feature rows: averages by name, defaults for whatever is missing."""
    averages = [F.coalesce(metric_value(windows, m), F.lit(0.0)).alias(f"avg_{m}") for m in FEATURES]
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("event_count", "anomaly_event_count")]
    return windows.select(
        "cell_id",
        F.coalesce("window_end", F.current_timestamp()).alias("window_end"),
        *averages,
        *counts,
        F.coalesce("region", F.lit(UNKNOWN)).alias("region"),
    )


def latest_features(features: DataFrame, view: FeatureView = CELL_FEATURES) -> DataFrame:
    return latest_per_key(features, view.entity, view.event_time)


def lookup(
    features: DataFrame,
    entities: DataFrame,
    view: FeatureView = CELL_FEATURES,
    columns: Sequence[str] | None = None,
    now: Column | None = None,
) -> DataFrame:
    """One row per requested entity; nulls where the table has no row, or none younger than the ttl.

    The semi join cuts the table down to what was asked for; the planner broadcasts the entities
    if their size allows. The ttl only applies when ``now`` is given.
    """
    wanted = features.join(entities, view.entity, "left_semi")
    if now is not None:
        oldest = now - F.expr(f"interval {view.ttl_seconds} seconds")
        wanted = wanted.filter((F.col(view.event_time) <= now) & (F.col(view.event_time) > oldest))
    kept = list(columns) if columns else view.features
    return entities.join(wanted.select(view.entity, *kept), view.entity, "left")


def _slot(micros: Column, width: int) -> Column:
    """Number of the epoch-aligned slot of this width, in whole numbers throughout."""
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint")


def _pieces(df: DataFrame, name: str, start: Column, until: Column, width: int) -> DataFrame:
    """One row per piece of the time line that [start, until) touches."""
    return df.withColumn(name, F.explode(F.sequence(_slot(start, width), _slot(until - 1, width))))


def validity_intervals(
    features: DataFrame, view: FeatureView = CELL_FEATURES, ttl_seconds: int | None = None
) -> DataFrame:
    """Disjoint ``[valid_from, valid_until)`` microsecond intervals, one feature row each.

    A row counts until the next one of its entity or until its ttl ends. The search for the next
    row looks no further than one ttl, so each entity is cut into pieces of that length.
    """
    ttl = (ttl_seconds or view.ttl_seconds) * _MICROS
    at = F.unix_micros(view.event_time)
    pieces = _pieces(features.withColumn("at", at), "piece", F.col("at"), F.col("at") + ttl, ttl)
    in_order = Window.partitionBy(view.entity, "piece").orderBy("at", *view.features)
    begin = F.col("piece") * ttl
    return (
        pieces.withColumn("next_at", F.lead("at").over(in_order))
        .withColumn("valid_from", F.greatest("at", begin))
        .withColumn("valid_until", F.least(F.col("at") + ttl, F.col("next_at"), begin + ttl))
        .filter("valid_until > valid_from")
        .drop("at", "piece", "next_at")
    )


def asof_features(
    events: DataFrame,
    features: DataFrame,
    view: FeatureView = CELL_FEATURES,
    at: str = "ts",
    ttl_seconds: int | None = None,
    bucket_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Each event with the newest feature row not later than it and younger than the ttl, else nulls.

    An equi-join on (entity, time bucket) with disjoint intervals: at most one match per event, and
    events never move when the feature table is small enough to broadcast. Otherwise a busy entity
    is spread over its buckets, and adaptive execution splits what is still skewed.
    """
    intervals = validity_intervals(features.select(view.entity, view.event_time, *view.features), view, ttl_seconds)
    width = bucket_seconds * _MICROS
    bucketed = _pieces(intervals, "bucket", F.col("valid_from"), F.col("valid_until"), width).alias("f")
    left = events.withColumn("bucket", _slot(F.unix_micros(at), width)).alias("e")
    moment = F.unix_micros(F.col(f"e.{at}"))
    matches = (
        (F.col(f"e.{view.entity}") == F.col(f"f.{view.entity}"))
        & (F.col("e.bucket") == F.col("f.bucket"))
        & (moment >= F.col("f.valid_from"))
        & (moment < F.col("f.valid_until"))
    )
    return left.join(bucketed, matches, "left").select(
        *[F.col(f"e.{c}") for c in events.columns],
        *[F.col(f"f.{c}").alias(c if c not in events.columns else f"feature_{c}") for c in (view.event_time, *view.features)],
    )


def store_status(online: DataFrame, view: FeatureView = CELL_FEATURES) -> DataFrame:
    """Number of entities and newest event time of the online table."""
    dated = F.col(view.event_time).isNotNull()
    return online.agg(
        F.count(F.lit(1)).alias("cells_materialized"),
        F.max(F.when(dated, F.col(view.event_time))).alias("last_updated"),
    )


def feature_age(online: DataFrame, now: Column, view: FeatureView = CELL_FEATURES) -> DataFrame:
    """How old each entity's features are."""
    return online.select(
        view.entity,
        age_seconds(F.col(view.event_time), now).alias("age_seconds"),
    ).select(
        view.entity,
        "age_seconds",
        (F.col("age_seconds") < FRESH_SECONDS).alias("is_fresh"),
        age_text(F.col("age_seconds")).alias("age"),
    )


def scorable(rows: DataFrame, metrics: Sequence[str] = FEATURES) -> DataFrame:
    """Only rows in which every feature is present."""
    return rows.dropna(subset=list(metrics))


def with_defaults(rows: DataFrame) -> DataFrame:
    """``unknown`` for a missing cell or region."""
    return rows.withColumn("cell_id", F.coalesce("cell_id", F.lit(UNKNOWN))).withColumn(
        "region", known_or_default(F.col("region"))
    )
