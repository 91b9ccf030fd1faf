"""Health classes: codes, names and the profile rule."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FEATURES, LABELS, PROFILES, UNKNOWN


def label_code(label: Column) -> Column:
    """Alphabetical code of a label, null for a name that has none."""
    codes = F.create_map(*[F.lit(x) for pair in zip(LABELS, range(len(LABELS))) for x in pair])
    return F.try_element_at(codes, label)


def label_name(code: Column, labels: Sequence[str] = LABELS) -> Column:
    """Label of a class code, ``unknown`` for a code outside the map; a fitted model brings its own labels."""
    names = F.create_map(*[F.lit(x) for pair in enumerate(labels) for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit(UNKNOWN))


def profile_distance(label: str, metrics: list[Column]) -> Column:
    """-2 log-likelihood of the metrics under a class profile, up to a shared constant."""
    profile = PROFILES[label]
    terms = [F.pow((x - mean) / sd, F.lit(2)) for x, (mean, sd) in zip(metrics, profile)]
    return sum(terms[1:], terms[0]) + 2.0 * sum(log(sd) for _, sd in profile)


def profile_code(prefix: str = "") -> Column:
    """Code of the likeliest class; a tie goes to the smaller code."""
    metrics = [F.col(prefix + m) for m in FEATURES]
    distances = [profile_distance(label, metrics) for label in LABELS]
    # array_position returns the first match, which is the tie-break.
    return (F.array_position(F.array(*distances), F.array_min(F.array(*distances))) - 1).cast("int")


def anomaly_share_rule(anomalies: Column, events: Column) -> Column:
    """Label from the anomalous share alone: none, at most half, more."""
    return F.when(anomalies == 0, "excellent").when(anomalies * 2 <= events, "good").otherwise("poor")
