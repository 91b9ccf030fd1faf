"""Rows matched with the bands (an interval per metric) that hold them: a range join made an equi-join by a binned index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARCHETYPES, FEATURES


def archetype_bands(spark: SparkSession) -> DataFrame:
    """The anomaly archetypes as a table of bands: ``archetype`` and ``<metric>_low`` and ``_high`` per metric."""
    rows = [(name, *[bound for band in bands for bound in band]) for name, bands in ARCHETYPES.items()]
    bounds = ", ".join(f"{m}_low double, {m}_high double" for m in FEATURES)
    return spark.createDataFrame(rows, f"archetype string, {bounds}")


def _index(bands: DataFrame, metrics: Sequence[str]) -> tuple[str, float]:
    """The metric whose bands cover least of its range, and their mean length: bins of that width hold three entries a band at most."""
    sums = []
    for m in metrics:
        length = F.col(f"{m}_high") - F.col(f"{m}_low")
        spread = F.max(f"{m}_high") - F.min(f"{m}_low")
        sums += [F.avg(length).alias(f"{m}_mean"), F.try_divide(F.avg(length), spread).alias(f"{m}_share")]
    row = bands.agg(*sums).first()
    best = min(metrics, key=lambda m: 1.0 if row[f"{m}_share"] is None else row[f"{m}_share"])
    return best, row[f"{best}_mean"] or 1.0


def band_join(rows: DataFrame, bands: DataFrame, name: str = "archetype", metrics: Sequence[str] = FEATURES) -> DataFrame:
    """``rows`` with the ``name`` of each band whose intervals, ends included, hold all their metrics: one row per band, null for none.

    One metric is cut into bins about as wide as a band. A band stands in each bin it touches and a row looks into its own bin
    only, where it meets any band at most once; the other metrics are checked there. Bands that lack a bound, or whose ends are
    crossed, hold nothing, nor do rows that lack a metric. The planner broadcasts a small table of bands; beyond that size rows are
    shuffled by bin, where adaptive execution splits a crowded one.
    """
    whole = reduce(and_, [F.col(f"{m}_low") <= F.col(f"{m}_high") for m in metrics])
    bands = bands.filter(whole)
    metric, width = _index(bands, metrics)
    bin_of = lambda x: F.floor(x / F.lit(width))
    covered = F.explode(F.sequence(bin_of(F.col(f"{metric}_low")), bin_of(F.col(f"{metric}_high")))).alias("__bin")
    bounds = [F.col(f"{m}_{side}").alias(f"__{m}_{side}") for m in metrics for side in ("low", "high")]
    indexed = bands.select(F.col(name).alias(f"__{name}"), *bounds, covered)
    inside = [F.col(m).between(F.col(f"__{m}_low"), F.col(f"__{m}_high")) for m in metrics]
    own = [c for c in rows.columns if c != name]
    joined = rows.join(indexed, reduce(and_, inside, bin_of(F.col(metric)) == F.col("__bin")), "left")
    return joined.select(*own, F.col(f"__{name}").alias(name))
