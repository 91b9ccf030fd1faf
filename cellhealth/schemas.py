"""Column contracts: every table the library reads or writes has its type stated here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Metric names in feature order, labels in code order, thresholds.
FEATURES = (
    "signal_strength_dbm",
    "throughput_mbps",
    "latency_ms",
    "call_drop_rate_percent",
    "packet_loss_percent",
    "jitter_ms",
)
LABELS = ("excellent", "good", "poor")
UNKNOWN = "unknown"

ANOMALY_ABOVE = {"latency_ms": 100.0, "call_drop_rate_percent": 2.0, "packet_loss_percent": 5.0}
ANOMALY_BELOW = {"signal_strength_dbm": -80.0}

# Decimal places a metric carries on the wire.
DECIMALS = {
    "signal_strength_dbm": 2,
    "throughput_mbps": 2,
    "latency_ms": 2,
    "call_drop_rate_percent": 3,
    "packet_loss_percent": 3,
    "jitter_ms": 2,
}

# Fixed values: [low, high] a cleaned metric may take; None is open.
CLEAN_RANGE = {
    "signal_strength_dbm": (-95.0, -30.0),
    "throughput_mbps": (5.0, 200.0),
    "latency_ms": (5.0, 80.0),
    "call_drop_rate_percent": (0.0, None),
    "packet_loss_percent": (0.0, None),
    "jitter_ms": (0.0, None),
}

# Fixed values: (mean, standard deviation) of each metric per health class, in feature order.
PROFILES = {
    "excellent": ((-50.0, 5.0), (120.0, 20.0), (20.0, 5.0), (0.3, 0.15), (0.2, 0.1), (1.5, 0.5)),
    "good": ((-65.0, 5.0), (70.0, 15.0), (45.0, 10.0), (1.0, 0.3), (1.0, 0.4), (3.5, 1.0)),
    "poor": ((-82.0, 5.0), (25.0, 10.0), (130.0, 30.0), (3.0, 0.8), (4.0, 1.5), (10.0, 3.0)),
}

# Fixed values: [low, high] of each metric per anomaly archetype, in feature order.
ARCHETYPES = {
    "poor_signal": ((-95.0, -80.0), (2.0, 15.0), (80.0, 200.0), (2.0, 5.0), (2.0, 8.0), (8.0, 20.0)),
    "high_latency": ((-70.0, -55.0), (10.0, 40.0), (150.0, 500.0), (1.5, 4.0), (1.0, 5.0), (10.0, 30.0)),
    "packet_storm": ((-65.0, -50.0), (5.0, 20.0), (50.0, 150.0), (1.0, 3.0), (5.0, 15.0), (15.0, 40.0)),
    "degraded": ((-80.0, -70.0), (15.0, 40.0), (60.0, 120.0), (2.0, 4.0), (2.0, 6.0), (5.0, 15.0)),
}

# Inputs in feature order with the class a fitted model must give.
GOLDEN_VECTORS = (
    ((-45.0, 150.0, 15.0, 0.1, 0.2, 0.5), "excellent"),
    ((-65.0, 75.0, 35.0, 0.8, 0.8, 2.5), "good"),
    ((-85.0, 20.0, 120.0, 3.0, 2.5, 8.0), "poor"),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_METRIC_DOUBLES = tuple((name, T.DoubleType()) for name in FEATURES)
STATS = ("avg", "min", "max", "p95")
STATS_STRUCT = _struct(*((stat, T.DoubleType()) for stat in STATS))

#: One raw event as it travels in a message value.
WIRE_SCHEMA = _struct(
    ("timestamp", T.DoubleType()),
    ("cell_id", T.StringType()),
    ("imsi", T.StringType()),
    ("region", T.StringType()),
    *_METRIC_DOUBLES,
)

#: One decoded event.
TELEMETRY_SCHEMA = _struct(
    ("event_id", T.LongType()),
    ("ts", T.TimestampType()),
    ("cell_id", T.StringType()),
    ("region", T.StringType()),
    *_METRIC_DOUBLES,
)

#: One row per cell and window.
WINDOW_SCHEMA = _struct(
    ("window_end", T.TimestampType()),
    ("window_size_seconds", T.IntegerType()),
    ("rolling_window_seconds", T.IntegerType()),
    ("cell_id", T.StringType()),
    ("region", T.StringType()),
    ("event_count", T.LongType()),
    ("anomaly_event_count", T.LongType()),
    *((name, STATS_STRUCT) for name in FEATURES),
    ("ingested_at", T.TimestampType()),
)

#: The same rows with flat statistics.
FLAT_WINDOW_SCHEMA = _struct(
    ("cell_id", T.StringType()),
    ("window_end", T.TimestampType()),
    ("last_ts", T.TimestampType()),
    ("region", T.StringType()),
    ("event_count", T.LongType()),
    ("anomaly_event_count", T.LongType()),
    *((f"{name}_{stat}", T.DoubleType()) for name in FEATURES for stat in STATS),
)

#: One row per scored window.
PREDICTION_SCHEMA = _struct(
    ("windowed_metrics_id", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("window_end", T.TimestampType()),
    ("cell_id", T.StringType()),
    ("region", T.StringType()),
    ("input_features", _struct(*_METRIC_DOUBLES)),
    ("prediction", _struct(("encoded", T.DoubleType()), ("label", T.StringType()))),
    ("event_count", T.LongType()),
    ("anomaly_event_count", T.LongType()),
)

#: One labelled sample for training.
TARGET = "network_health_score"
TRAINING_SCHEMA = _struct(
    ("window_end", T.TimestampType()),
    ("cell_id", T.StringType()),
    ("region", T.StringType()),
    ("event_count", T.LongType()),
    *_METRIC_DOUBLES,
    (TARGET, T.StringType()),
)

#: One feature row per cell and window.
FEATURE_SCHEMA = _struct(
    ("cell_id", T.StringType()),
    ("window_end", T.TimestampType()),
    *((f"avg_{name}", T.DoubleType()) for name in FEATURES),
    ("event_count", T.LongType()),
    ("anomaly_event_count", T.LongType()),
    ("region", T.StringType()),
)

#: One row per training run.
RUN_SCHEMA = _struct(
    ("run_name", T.StringType()),
    ("started_at", T.TimestampType()),
    ("tags", T.MapType(T.StringType(), T.StringType())),
    ("params", T.MapType(T.StringType(), T.StringType())),
    ("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ("labels", T.ArrayType(T.StringType())),
    ("model_path", T.StringType()),
)


@dataclass(frozen=True)
class FeatureView:
    """A keyed, time-stamped table whose rows stay valid for ``ttl_seconds``."""

    name: str
    entity: str
    event_time: str
    ttl_seconds: int
    schema: T.StructType

    @property
    def features(self) -> list[str]:
        return [f.name for f in self.schema if f.name not in (self.entity, self.event_time)]


# The key, the time column and the seconds a feature row stays valid.
CELL_FEATURES = FeatureView("cell_window_features", "cell_id", "window_end", 30 * 60, FEATURE_SCHEMA)
