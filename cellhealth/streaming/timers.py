"""Timed emission: each cell reports every interval of processing time, at a phase of its own.

The event-time windows of ``queries`` are the default. This mode is for consumers that want a row
per cell at a steady pace whatever the event times say.

Two keyed steps share a busy cell among workers. The first keeps, per cell and salt, how often each value occurred, until the cell's
next boundary; as a batch fires every timer that is due, the salts of a cell hand on their counts in one batch. The second, keyed by
the cell, adds up what comes in that batch, so it sees a row per salt and distinct value, never per event, and keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numeric import average_of, to_milli
from ..functions.telemetry import is_anomaly, known_or_default
from ..operators.windows import WINDOW_SECONDS, to_documents
from ..schemas import FEATURES

#: The position after the last metric stands for the event itself; its value is 1 for an anomaly.
_EVENT = len(FEATURES)
_COUNTED = "cell_id string, salt int, phase bigint, metric int, milli bigint, region string, n bigint, first_ts bigint"
#: What a salt hands on: counts per value, those of the events themselves with their earliest region, and the boundary they end at.
_PARTIAL = "cell_id string, due bigint, metric int, milli bigint, region string, n bigint, first_ts bigint"
_EMPTY = (0, 0, None, None)
#: Shares that a cell's events are dealt into.
SALTS = 16

_TOTALS = T.StructType(
    [
        T.StructField("event_count", T.LongType()),
        T.StructField("anomaly_event_count", T.LongType()),
        T.StructField("first_ts", T.LongType()),
        T.StructField("region", T.StringType()),
    ]
)

#: What the processor emits: counts, and per metric the figures the statistics follow from.
_EMITTED = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("region", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("anomaly_event_count", T.LongType()),
        *[T.StructField(f"{m}_{s}", T.LongType()) for m in FEATURES for s in ("n", "sum", "min", "max", "p95")],
    ]
)


def _added(totals: tuple, seen: pd.DataFrame) -> tuple:
    """(events, anomalies, first time with a region, that region) with the rows that stand for events added."""
    events, anomalies, first_ts, region = totals
    events += int(seen["n"].sum())
    anomalies += int((seen["n"] * seen["milli"]).sum())
    named = seen[seen["region"].notna()]
    if len(named):
        at, name = min(zip(named["first_ts"], named["region"]))
        if first_ts is None or (int(at), name) < (first_ts, region):
            first_ts, region = int(at), name
    return events, anomalies, first_ts, region


class SaltedCounts(StatefulProcessor):
    """Counts per cell and salt between two boundaries: totals, and how often each metric took each value."""

    def __init__(self, interval_ms: int):
        self._interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._totals = handle.getValueState("totals", _TOTALS)
        self._values = handle.getMapState("values", "metric int, milli bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idle = not self._totals.exists()
        totals, phase = _EMPTY if idle else self._totals.get(), 0
        for batch in rows:
            phase = int(batch["phase"].iloc[0])
            totals = _added(totals, batch[batch["metric"] == _EVENT])
            values = batch[batch["metric"] != _EVENT].groupby(["metric", "milli"])["n"].sum()
            for (metric, milli), n in values.items():
                self._count(int(metric), int(milli), int(n))
        self._totals.update(totals)
        if idle:  # boundaries are the cell's, the same for all its salts
            now = timerValues.getCurrentProcessingTimeInMs()
            self._handle.registerTimer(now + self._interval - (now - phase) % self._interval)
        yield pd.DataFrame()

    def _count(self, metric: int, milli: int, n: int) -> None:
        at = (metric, milli)
        before = self._values.getValue(at)[0] if self._values.containsKey(at) else 0
        self._values.updateValue(at, (before + n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, anomalies, first_ts, region = self._totals.get()
        rows = [(metric, milli, None, v[0], None) for (metric, milli), v in self._values.iterator()]
        rows += [(_EVENT, 0, region, events - anomalies, first_ts), (_EVENT, 1, None, anomalies, None)]
        self._totals.clear()
        self._values.clear()
        frame = pd.DataFrame(rows, columns=["metric", "milli", "region", "n", "first_ts"]).astype({"first_ts": "Int64"})
        yield frame.assign(cell_id=key[0], due=expiredTimerInfo.getExpiryTimeInMs())[["cell_id", "due", *frame.columns]]

    def close(self) -> None:
        pass


class CellRows(StatefulProcessor):
    """A row per cell and boundary from the counts its salts handed on, which come in one batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(rows)
        for due, part in parts.groupby("due"):
            totals = _added(_EMPTY, part[part["metric"] == _EVENT])
            yield self._row(key[0], int(due), totals, part[part["metric"] != _EVENT])

    @staticmethod
    def _row(cell: str, due: int, totals: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        events, anomalies, _, region = totals
        row = {
            "cell_id": cell,
            "window_end": datetime.fromtimestamp(due / 1000, timezone.utc),
            "region": region,
            "event_count": events,
            "anomaly_event_count": anomalies,
        }
        values = counts.groupby(["metric", "milli"], as_index=False)["n"].sum().sort_values(["metric", "milli"])
        for i, m in enumerate(FEATURES):
            mine = values[values["metric"] == i]
            total = int(mine["n"].sum())
            row[f"{m}_n"] = total
            row[f"{m}_sum"] = int((mine["milli"] * mine["n"]).sum())
            row[f"{m}_min"] = int(mine["milli"].iloc[0]) if total else None
            row[f"{m}_max"] = int(mine["milli"].iloc[-1]) if total else None
            place = min(19 * total // 20, total - 1) + 1
            row[f"{m}_p95"] = int(mine["milli"][mine["n"].cumsum() >= place].iloc[0]) if total else None
        frame = pd.DataFrame([row])
        whole = [f"{m}_{s}" for m in FEATURES for s in ("min", "max", "p95")]
        return frame.astype({c: "Int64" for c in whole})

    def close(self) -> None:
        pass


def _phase(interval_ms: int) -> Column:
    """A cell's share of the interval, the same on every run."""
    return F.pmod(F.xxhash64("cell_id"), F.lit(interval_ms))


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts within each Arrow batch, so that a busy cell sends few rows to its workers."""
    keys = ["cell_id", "salt", "phase", "metric", "milli", "region"]
    for batch in batches:
        grouped = batch.groupby(keys, dropna=False, as_index=False)
        yield grouped.agg(n=("ts_micros", "size"), first_ts=("ts_micros", "min"))


def timed_windows(events: DataFrame, size: int = WINDOW_SECONDS, salts: int = SALTS) -> DataFrame:
    """Window rows emitted by a processing-time timer per cell; nothing for an idle interval.

    Needs the RocksDB state store. An event goes to the salt that its metrics' values choose, so equal ones are counted together
    before the shuffle, and a salt's state is bounded by the number of distinct values, in thousandths, its share takes within
    one interval.
    """
    salt = F.pmod(F.xxhash64(*[F.col(m) for m in FEATURES]), F.lit(salts)).cast("int")
    values = F.array(*[to_milli(F.col(m)) for m in FEATURES], F.when(is_anomaly(), 1).otherwise(0).cast("bigint"))
    single = events.select(
        "cell_id",
        salt.alias("salt"),
        _phase(size * 1000).alias("phase"),
        F.unix_micros("ts").alias("ts_micros"),
        "region",
        F.posexplode(values).alias("metric", "milli"),
    ).filter(F.col("milli").isNotNull())
    of_event = F.when(F.col("metric") == _EVENT, F.col("region"))
    prepared = single.withColumn("region", of_event).mapInPandas(_combined, _COUNTED)
    handed_on = prepared.groupBy("cell_id", "salt").transformWithStateInPandas(
        statefulProcessor=SaltedCounts(size * 1000),
        outputStructType=_PARTIAL,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    emitted = handed_on.groupBy("cell_id").transformWithStateInPandas(
        statefulProcessor=CellRows(),
        outputStructType=_EMITTED,
        outputMode="Append",
        timeMode="None",
    )
    stats = []
    for m in FEATURES:
        stats.append(average_of(F.col(f"{m}_sum"), F.col(f"{m}_n")).alias(f"{m}_avg"))
        stats += [F.coalesce(F.col(f"{m}_{s}") / 1e3, F.lit(0.0)).alias(f"{m}_{s}") for s in ("min", "max", "p95")]
    flat = emitted.select(
        "cell_id",
        "window_end",
        known_or_default(F.col("region")).alias("region"),
        "event_count",
        "anomaly_event_count",
        *stats,
    )
    return to_documents(flat, size)
