"""Predicates and conversions on single events."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANOMALY_ABOVE, ANOMALY_BELOW, ARCHETYPES, FEATURES, UNKNOWN

# Identity patterns, peak hours and their factor, seconds a feature counts as fresh.
CELL_PATTERN = r"^CELL_[0-9]{4,}$"
SUBSCRIBER_PATTERN = r"^505[0-9]{10}$"
PEAK_HOURS = (8, 18)
OFF_PEAK_FACTOR = 0.7
FRESH_SECONDS = 300


def is_anomaly() -> Column:
    """Any metric strictly beyond its threshold; a missing one reads as 0 and never fires."""
    beyond = [F.coalesce(F.col(m), F.lit(0.0)) > limit for m, limit in ANOMALY_ABOVE.items()]
    beyond += [F.coalesce(F.col(m), F.lit(0.0)) < limit for m, limit in ANOMALY_BELOW.items()]
    return reduce(or_, beyond)


def known_or_default(x: Column) -> Column:
    """``unknown`` for a null or empty text."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(UNKNOWN))


def matching_archetypes() -> Column:
    """Names of the archetypes whose six bands all hold the event's metrics."""
    names = []
    for name, bands in ARCHETYPES.items():
        inside = [F.col(m).between(low, high) for m, (low, high) in zip(FEATURES, bands)]
        names.append(F.when(reduce(lambda a, b: a & b, inside), F.lit(name)))
    return F.array_compact(F.array(*names))


def from_epoch(seconds: Column) -> Column:
    """Fractional epoch seconds to a timestamp, to the microsecond."""
    return F.timestamp_micros(F.floor(seconds * 1e6 + 0.5))


def to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def iso_utc(ts: Column) -> Column:
    """Fixed-width ISO-8601 text with a ``Z``, in the session's UTC zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def bin_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bin of this width."""
    micros = seconds * 1_000_000
    at = F.unix_micros(ts)
    return F.timestamp_micros(at - F.pmod(at, F.lit(micros)))


def peak_factor(ts: Column) -> Column:
    """1.0 in the peak hours, both ends included, else the off-peak factor."""
    return F.when(F.hour(ts).between(*PEAK_HOURS), 1.0).otherwise(OFF_PEAK_FACTOR)


def cell_name(number: Column) -> Column:
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("CELL_"), padded)


def age_seconds(since: Column, now: Column) -> Column:
    """Whole seconds between two times, rounded half up."""
    return F.floor((F.unix_micros(now) - F.unix_micros(since)) / 1e6 + 0.5)


def age_text(age: Column) -> Column:
    """Short form of an age: seconds, then minutes, then hours."""
    minutes = F.floor(age / 60.0 + 0.5).cast("string")
    hours = F.floor(age / 3600.0 + 0.5).cast("string")
    return (
        F.when(age < 60, F.concat(age.cast("string"), F.lit("s ago")))
        .when(age < 3600, F.concat(minutes, F.lit("m ago")))
        .otherwise(F.concat(hours, F.lit("h ago")))
    )
