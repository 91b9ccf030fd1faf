"""Telemetry, windows and predictions derived from the given ``events`` and ``region`` tables.

The tables span days where live telemetry spans minutes, so windows are one day wide here.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_name, profile_code
from ..functions.telemetry import cell_name
from ..operators.features import latest_features
from ..operators.windows import as_features, flat_windows
from ..schemas import FLAT_WINDOW_SCHEMA, TELEMETRY_SCHEMA
from ..session import apply_settings, checkpoint_root, tables_root
from ..sources.tables import DayTable, OnlineTable
from ..streaming import queries

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-day windows with their labels as a stored table, partitioned by ``day``, the date of the window's end.

    Written once per application and source folder, below the shared folder, in files of balanced size; readers
    prune days. ``drop_tables`` deletes it.
    """
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    path = f"{tables_root(spark)}/{name}/windows"
    folder, fs = _folder(spark, path)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
        rows = with_labels(windowed(spark, sf_dir)).withColumn("day", F.to_date("window_end"))
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def online_table(spark: SparkSession, sf_dir: str) -> OnlineTable:
    """The online table of the one-day windows' newest rows, stored once per application and source folder."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    online = OnlineTable(spark, f"{tables_root(spark)}/{name}/online")
    if not online.filled():
        online.upsert(latest_features(window_table(spark, sf_dir)))
    return online


def streamed_windows(spark: SparkSession, sf_dir: str, slide: int | None = None, size: int = DAY) -> DataFrame:
    """The windows of the telemetry as a stream leaves them in a table by day: every 7th message comes twice, and a last one, far
    ahead, closes all windows but its own. Every statistic is exact. Runs the stream to its end; each call writes tables of its own."""
    root = f"{tables_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    sent = telemetry(spark, sf_dir).select(*TELEMETRY_SCHEMA.names)
    ahead = F.make_dt_interval(days=F.lit(10 + 2 * size // DAY))
    closing = sent.agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts")).select(
        (F.col("event_id") + 1).alias("event_id"), (F.col("ts") + ahead).alias("ts"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in TELEMETRY_SCHEMA.fields[2:]]
    )
    sent.unionByName(sent.filter(F.col("event_id") % 7 == 0)).unionByName(closing).write.parquet(f"{root}/messages")
    messages = spark.readStream.schema(TELEMETRY_SCHEMA).parquet(f"{root}/messages")
    # The files come in no order of time; one batch takes them all, so that none is late.
    table = DayTable(spark, f"{root}/windows", FLAT_WINDOW_SCHEMA)
    queries.exact_windows_by_day(messages, table, f"{root}/checkpoint", size, slide, "1 hour").awaitTermination()
    return table.read()


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables stored for this application."""
    folder, fs = _folder(spark, tables_root(spark))
    fs.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stored(df: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder: for operators that read a stored table several times."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def _by_kind(excellent: Column, normal: Column, anomaly: Column) -> Column:
    kind = F.col("kind")
    return F.when(kind == "excellent", excellent).when(kind == "normal", normal).otherwise(anomaly)


def _hundredths(x: Column) -> Column:
    return F.floor(x) / 1e2


def _thousandths(x: Column) -> Column:
    return F.floor(x) / 1e3


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry event per row of ``events``: 50 cells, a tenth of them always or often anomalous."""
    apply_settings(spark)
    c, k, v = F.col("c"), F.col("k"), F.col("v")
    kind = (
        F.when(c < 3, "anomaly")
        .when(c < 9, F.when(k % 10 < 6, "anomaly").otherwise("normal"))
        .when(c < 24, "excellent")
        .otherwise(F.when(k % 20 == 0, "anomaly").otherwise("normal"))
    )
    base = (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("v"),
            (F.col("user_id") % 50).alias("c"),
            # Cut out of {"k": 69}.
            F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("int").alias("k"),
        )
        .withColumn("kind", kind)
        .withColumn("f", v)
    )
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    f = F.col("f")
    loss = _by_kind(0.02 + _thousandths(k * 1.5), 0.1 + _thousandths(f * 2.0), 1.0 + _thousandths(k * 90.0))
    # The region table has five rows; its file size lets the planner broadcast it.
    return base.join(region, F.col("r_regionkey") == c % 5).select(
        "event_id",
        "ts",
        cell_name(c).alias("cell_id"),
        F.concat(F.lit("505"), (10 + k % 90).cast("string"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("imsi"),
        "region",
        _by_kind(-40.0 - _hundredths(k * 16.0), -45.0 - _hundredths(k * 30.0), -70.0 - _hundredths(k * 25.0)).alias("signal_strength_dbm"),
        _by_kind(90.0 + _hundredths(f * 35.0), 40.0 + _hundredths(f * 40.0), 2.0 + _hundredths(f * 19.0)).alias("throughput_mbps"),
        _by_kind(10.0 + _hundredths(k * 16.0), 10.0 + _hundredths(f * 20.0), 60.0 + _hundredths(k * 140.0)).alias("latency_ms"),
        _by_kind(0.1 + _thousandths(f * 1.0), 0.2 + _thousandths(k * 6.0), 1.0 + _thousandths(f * 20.0)).alias("call_drop_rate_percent"),
        F.when(F.col("event_id") % 97 != 0, loss).alias("packet_loss_percent"),
        _by_kind(0.5 + _hundredths(f * 0.5), 1.0 + _hundredths(k * 3.0), 5.0 + _hundredths(f * 12.5)).alias("jitter_ms"),
    )


def settled(events: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that a filter on a metric reads the metric instead of
    repeating, down at the scan, the expression it is derived by."""
    return events.select(F.inline(F.array(F.struct(*events.columns))))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-day windows with their averages."""
    return as_features(flat_windows(telemetry(spark, sf_dir), DAY, stats=("avg",)))


def with_labels(windows: DataFrame) -> DataFrame:
    """The profile labeller in place of a fitted model: adds ``encoded`` and ``label``."""
    return windows.withColumn("encoded", profile_code("avg_")).withColumn("label", label_name(F.col("encoded")))


def as_predictions(labelled: DataFrame) -> DataFrame:
    """Prediction rows, stamped with the window's last event; a stored table's ``day`` stays."""
    return labelled.select(
        *[c for c in labelled.columns if c == "day"],
        "cell_id",
        "region",
        "window_end",
        F.col("last_ts").alias("timestamp"),
        "event_count",
        "anomaly_event_count",
        "encoded",
        "label",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per window."""
    return as_predictions(with_labels(windowed(spark, sf_dir)))
