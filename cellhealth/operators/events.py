"""Row-wise operators on telemetry: all narrow, none shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up
from ..functions.telemetry import (
    CELL_PATTERN,
    SUBSCRIBER_PATTERN,
    is_anomaly,
    matching_archetypes,
    peak_factor,
)
from ..schemas import CLEAN_RANGE, DECIMALS


def anomalies(events: DataFrame) -> DataFrame:
    return events.filter(is_anomaly())


def rounded(events: DataFrame) -> DataFrame:
    """Each metric to the decimals it has on the wire."""
    return events.withColumns({m: half_up(F.col(m), places) for m, places in DECIMALS.items()})


def clamped(events: DataFrame) -> DataFrame:
    """Each metric forced into its clean range."""
    return events.withColumns({m: clamp(F.col(m), *bounds) for m, bounds in CLEAN_RANGE.items()})


def normalised_latency(events: DataFrame) -> DataFrame:
    """Latency with the hour's load taken out."""
    return events.withColumn("peak_factor", peak_factor(F.col("ts"))).withColumn(
        "normalised_latency_ms", half_up(F.col("latency_ms") / F.col("peak_factor"))
    )


def checked_ids(events: DataFrame) -> DataFrame:
    """Whether the identifiers have the required form."""
    return events.withColumns(
        {
            "cell_id_ok": F.col("cell_id").rlike(CELL_PATTERN),
            "imsi_ok": F.col("imsi").rlike(SUBSCRIBER_PATTERN),
        }
    )


def with_archetypes(events: DataFrame) -> DataFrame:
    """Anomalous events with each archetype they fit, one row per archetype, null for none."""
    return anomalies(events).withColumn("archetype", F.explode_outer(matching_archetypes()))
