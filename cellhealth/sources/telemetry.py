"""Raw telemetry: message sources, decoding, and the keyed JSON form events are sent in."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.telemetry import from_epoch, to_epoch
from ..schemas import FEATURES, UNKNOWN, WIRE_SCHEMA

TOPIC = "raw-telemetry"
GROUP = "cell-windows"

#: A metric beyond this is no measurement. A window's sum in thousandths then overflows beyond 9e9 events only.
METRIC_LIMIT = 1e6
#: Seconds an event's time may lie ahead of its arrival, or of now.
AHEAD = 86_400

_CORRUPT = "_corrupt"
_DECODED = T.StructType([*WIRE_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])


def message_stream(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    group: str = GROUP,
    starting: str = "latest",
    max_per_trigger: int | None = None,
) -> DataFrame:
    """``key, value, arrived_at`` from a Kafka topic; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("groupIdPrefix", group)
        .option("startingOffsets", starting)
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("arrived_at"),
    )


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same messages as lines of text files that keep arriving in a directory."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def decode(messages: DataFrame) -> DataFrame:
    """One row per message with its fields, and ``malformed`` where it cannot be an event.

    Malformed is: not JSON, not an object, a field of the wrong type, no event time and no arrival time, a time
    before the epoch or more than ``AHEAD`` after the arrival, or a metric that is not finite or beyond
    ``METRIC_LIMIT``: one such message would stop the windows or the watermark of all others. A missing region is ``unknown``, an explicit null stays null until a window
    looks for its first region. Messages may bring an ``event_id``; else it is a hash of the text.
    """
    event_id = F.col("event_id") if "event_id" in messages.columns else F.xxhash64("value")
    fields = F.from_json("value", _DECODED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    parsed = F.struct(fields.alias("e"), F.json_object_keys("value").alias("present"))
    # Filters do not move below a generator, so each message is parsed once, not once per filter.
    staged = messages.select("*", F.inline(F.array(parsed)))
    seconds = F.col("e.timestamp")
    ts, arrived = from_epoch(F.when(seconds.between(0.0, 1e11), seconds)), F.current_timestamp()
    if "arrived_at" in messages.columns:
        ts = F.coalesce(ts, F.when(seconds.isNull(), F.col("arrived_at")))
        arrived = F.coalesce("arrived_at", arrived)
    ahead = F.coalesce(ts > arrived + F.expr(f"interval {AHEAD} seconds"), F.lit(False))
    beyond = reduce(or_, [F.coalesce(~(F.abs(F.col(f"e.{m}")) <= METRIC_LIMIT), F.lit(False)) for m in FEATURES])
    region = F.when(~F.array_contains("present", "region"), F.lit(UNKNOWN)).otherwise(F.col("e.region"))
    broken = F.col("present").isNull() | F.col(f"e.{_CORRUPT}").isNotNull() | ts.isNull() | ahead | beyond
    return staged.select(
        "value",
        F.coalesce(broken, F.lit(True)).alias("malformed"),
        event_id.alias("event_id"),
        ts.alias("ts"),
        F.coalesce("e.cell_id", F.lit(UNKNOWN)).alias("cell_id"),
        F.col("e.imsi").alias("imsi"),
        region.alias("region"),
        *[F.col(f"e.{m}").alias(m) for m in FEATURES],
    )


def accepted(decoded: DataFrame, keep_subscriber: bool = False) -> DataFrame:
    """Well-formed events; the subscriber id is personal data and is dropped unless asked for."""
    events = decoded.filter(~F.col("malformed")).drop("value", "malformed")
    return events if keep_subscriber else events.drop("imsi")


def rejected(decoded: DataFrame) -> DataFrame:
    """The messages set aside, as they came."""
    return decoded.filter("malformed").select("event_id", "value")


def parse_telemetry(messages: DataFrame) -> DataFrame:
    return accepted(decode(messages))


def wire_json(events: DataFrame) -> Column:
    """The wire fields of an event as JSON text."""
    wire = [F.col(f) for f in WIRE_SCHEMA.names if f in events.columns and f != "timestamp"]
    return F.to_json(F.struct(to_epoch(F.col("ts")).alias("timestamp"), *wire))


def keyed_json(events: DataFrame) -> DataFrame:
    """Events as messages: the cell id as key bytes, the wire fields as a JSON value."""
    return events.select(F.col("cell_id").cast("binary").alias("key"), wire_json(events).alias("value"))
