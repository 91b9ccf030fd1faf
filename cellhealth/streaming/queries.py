"""Streaming queries from messages to windows, predictions and the online table.

Every table written here goes through the file sink's commit log, takes each numbered batch once, or is an upsert
that may be repeated, so a restart from the checkpoint neither loses nor doubles a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..model.scoring import score
from ..operators.features import feature_rows, latest_features
from ..operators.windows import WINDOW_SECONDS, cell_windows, counted_windows, flat_windows, windows_of_counts
from ..schemas import WINDOW_SCHEMA
from ..session import passing_tables
from ..sources.tables import DayTable, OnlineTable
from ..sources.telemetry import keyed_json

LATENESS = "1 minute"
REFRESH = "2 minutes"

#: Window state outgrows executor memory at scale; RocksDB keeps it on disk.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def checkpoint_for(spark: SparkSession, name: str) -> str:
    """A query's checkpoint folder below the durable one that ``spark.checkpoint.dir`` names.

    A temporary folder would make a restarted query forget where it was, so none is made up, not even locally.
    """
    durable = spark.conf.get("spark.checkpoint.dir", None)
    if durable is None:
        raise RuntimeError("set spark.checkpoint.dir to a durable folder")
    return f"{durable.rstrip('/')}/{name}"


def once_delivered(events: DataFrame, lateness: str = LATENESS, ids: Sequence[str] = ("event_id",)) -> DataFrame:
    """The stream with its watermark, each message once: an at-least-once source may send one again.

    A second delivery is dropped while the first is no older than the watermark's delay, for which its id is kept; one that comes
    later than that is late. Messages without an id are known by a hash of their text (``decode``).
    """
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(ids))


def window_stream(
    events: DataFrame,
    size: int = WINDOW_SECONDS,
    slide: int | None = None,
    lateness: str = LATENESS,
    flat: bool = False,
    p95: str = "sketch",
    once: bool = True,
) -> DataFrame:
    """The window operator over a stream: rows leave when the watermark passes their window's end.

    With ``once``, the default, messages that were delivered again are dropped first, which costs a shuffle by message id.
    """
    marked = once_delivered(events, lateness) if once else events.withWatermark("ts", lateness)
    return flat_windows(marked, size, slide, p95=p95) if flat else cell_windows(marked, size, slide, p95)


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def append_to_table(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table, each row once; without ``every`` it stops when caught up."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(**_trigger(every))
        .start()
    )


def append_by_day(
    rows: DataFrame, table: DayTable, checkpoint: str, every: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append a stream to a table partitioned by day, each batch once, its small files merged as they gather.

    The table knows a batch by the query's id, which lives in the checkpoint, and its number. ``finish`` makes the table's rows of
    a batch's; what it stores on the way is deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        writer = query or checkpoint
        if table.has(number, writer):
            batch.write.format("noop").mode("overwrite").save()  # there already; its state must still be made and committed
        else:
            with passing_tables(batch.sparkSession):
                table.append(finish(batch) if finish else batch, number, writer)
        table.compact()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**_trigger(every)).start()


def exact_windows_by_day(
    events: DataFrame,
    table: DayTable,
    checkpoint: str,
    size: int = WINDOW_SECONDS,
    slide: int | None = None,
    lateness: str = LATENESS,
    once: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Flat windows (``FLAT_WINDOW_SCHEMA``) as ``window_stream`` has them, into a table by day, with exact p95s whatever a window's size.

    The stream keeps counts of values instead of sketches; each batch's closed windows are finished as a table.
    """
    marked = once_delivered(events, lateness) if once else events.withWatermark("ts", lateness)
    return append_by_day(counted_windows(marked, size, slide), table, checkpoint, every, windows_of_counts)


def inserted_windows(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The rows newly appended to a window table, whole and in commit order."""
    reader = spark.readStream.schema(WINDOW_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_inserted(
    spark: SparkSession, model: PipelineModel, windows_path: str, predictions_path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Score each window once, right after it was written."""
    return append_to_table(score(model, inserted_windows(spark, windows_path)), predictions_path, checkpoint, every)


def refresh_online(
    windows: DataFrame, online: OnlineTable, checkpoint: str, every: str | None = REFRESH
) -> StreamingQuery:
    """Keep the online table at the newest window of each cell."""

    def merge(batch: DataFrame, _: int) -> None:
        online.upsert(latest_features(feature_rows(batch)))

    return (
        windows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def send_messages(events: DataFrame, servers: str, topic: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Events to a Kafka topic, keyed by cell."""
    return (
        keyed_json(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def send_lines(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The same messages as text files, where there is no broker."""
    return (
        keyed_json(events)
        .select(F.col("value"))
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


class LateRows(StreamingQueryListener):
    """Counts the aggregated rows the watermark drops, per query, over all batches of its run.

    Add it with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self._dropped: dict[str, int] = {}
        self._seen: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        self._dropped[run] = self._dropped.get(run, 0) + late
        self._seen[run] = progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def count(self, query: StreamingQuery) -> int:
        """Rows dropped in the query's present run, as far as its progress has been reported."""
        return self._dropped.get(str(query.runId), 0)

    def last_batch(self, query: StreamingQuery) -> int:
        """The last batch that has been counted, -1 for none."""
        return self._seen.get(str(query.runId), -1)
