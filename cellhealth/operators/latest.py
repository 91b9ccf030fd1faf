"""Newest row per key, and what is built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, newest_by: str) -> DataFrame:
    """The whole newest row of each key.

    The newest time per key is a hash aggregate, combined before the shuffle; the rows of that time are
    joined back, and a maximum over their remaining columns makes one defined winner of a tie. Only those few
    rows are sorted. Reads ``df`` twice, so it should be a stored table where its making is costly.
    """
    rest = [c for c in df.columns if c not in (key, newest_by)]
    times = df.groupBy(F.col(key).alias("__key")).agg(F.max(newest_by).alias("__newest"))
    last = df.join(times, F.col(key).eqNullSafe(F.col("__key")) & F.col(newest_by).eqNullSafe(F.col("__newest")), "left_semi")
    newest = F.max(F.struct(newest_by, *rest)).alias("newest")
    return last.groupBy(key).agg(newest).select(key, *[F.col(f"newest.{c}").alias(c) for c in (newest_by, *rest)])


def upsert_latest(stored: DataFrame, fresh: DataFrame, key: str, newest_by: str) -> DataFrame:
    """Stored and fresh rows merged; each key keeps its newest."""
    return latest_per_key(stored.unionByName(fresh), key, newest_by)


def newest_rows(df: DataFrame, newest_by: str, tie_break: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest rows: a per-partition top-n, then one merge of n rows per partition."""
    return df.orderBy(F.desc(newest_by), *tie_break).limit(n)
