"""The bounded sample of each cell's window in a stream: the rows with the least digests, as the batch sample takes them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sampling import RESERVOIR, SEED, row_digest
from ..operators.windows import WINDOW_SECONDS


class LeastDigests(StatefulProcessor):
    """Per key, at most ``cap`` rows by digest; they leave when the watermark passes the window's end."""

    def __init__(self, cap: int, groups: Sequence[str]):
        self._cap, self._groups = cap, list(groups)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getMapState("rows", "digest string", "row string")
        self._timed = handle.getValueState("timed", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self._rows.iterator()}
        before = set(held)
        for batch in rows:
            held.update(zip(batch["digest"], batch["row"]))
            if len(held) > 2 * self._cap:
                held = {d: held[d] for d in sorted(held)[: self._cap]}
        held = {d: held[d] for d in sorted(held)[: self._cap]}
        for digest in before - set(held):
            self._rows.removeKey((digest,))
        for digest in set(held) - before:
            self._rows.updateValue((digest,), (held[digest],))
        if not self._timed.exists():
            end = int(key[0].timestamp() * 1000)
            self._handle.registerTimer(end)
            self._timed.update((end,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(k[0], v[0]) for k, v in self._rows.iterator()]
        self._rows.clear()
        self._timed.clear()
        frame = pd.DataFrame(held, columns=["digest", "row"])
        yield frame.assign(**dict(zip(self._groups, key)))[[*self._groups, "digest", "row"]]

    def close(self) -> None:
        pass


def sampled_windows(
    events: DataFrame, keys: Sequence[str] = ("cell_id",), ids: Sequence[str] = ("event_id",), size: int = WINDOW_SECONDS, cap: int = RESERVOIR, seed: int = SEED, salts: int = 64
) -> DataFrame:
    """``window_end`` and the sampled rows of a stream with its watermark set: at most ``cap`` per key and window, those of the
    batch sample (``bounded_sample`` over the same keys and window).

    State is ``cap`` rows a key, window and salt: rows are dealt by their digest, each share keeps its least, and a second step over
    what the shares hand on takes the least of all, so a busy cell is not one worker's. A row delivered again has the same digest
    and counts once. Rows without an id, or with that of another row of their window, share a digest and count once too. Needs the
    RocksDB state store.
    """
    window = F.window("ts", f"{size} seconds")
    digest = row_digest(ids, seed)
    kept = [c for c in events.columns]
    schema = T.StructType([events.schema[c] for c in kept])
    row = F.to_json(F.struct(*kept), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
    dealt = events.select(window["end"].alias("window_end"), *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], digest.alias("digest"), row.alias("row"), F.col("ts"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))
    groups = ["window_end", *[f"key_{i}" for i in range(len(keys))]]
    handed_on = T.StructType([*[dealt.schema[g] for g in groups], T.StructField("digest", T.StringType()), T.StructField("row", T.StringType())])
    taken = dealt
    for by in ([*groups, "salt"], groups):
        taken = taken.groupBy(*by).transformWithStateInPandas(
            statefulProcessor=LeastDigests(cap, groups), outputStructType=handed_on, outputMode="Append", timeMode="EventTime", eventTimeColumnName="window_end"
        )
    opened = F.from_json("row", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return taken.select("window_end", F.inline(F.array(opened)))
