"""Apply a fitted classifier to window rows, static or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_name
from ..functions.telemetry import iso_utc
from ..operators.features import scorable
from ..operators.windows import metric_value
from ..schemas import FEATURES, LABELS


def window_id() -> Column:
    """Identity of a window row, the same on every run."""
    return F.concat_ws("@", "cell_id", iso_utc(F.col("window_end")))


def model_inputs(windows: DataFrame) -> DataFrame:
    """Window rows with one plain number per metric; rows that miss any are not scored."""
    values = {m: metric_value(windows, m) for m in FEATURES}
    return scorable(windows.withColumns(values))


def model_labels(model: PipelineModel) -> list[str]:
    """The labels a fitted model numbered, in the order of its codes; they are stored and loaded with it."""
    return list(next(stage.labels for stage in model.stages if isinstance(stage, StringIndexerModel)))


def prediction_rows(scored: DataFrame, code: str = "prediction", labels: Sequence[str] = LABELS) -> DataFrame:
    """The stored shape of a prediction: its inputs and its outcome as structs."""
    return scored.select(
        window_id().alias("windowed_metrics_id"),
        F.current_timestamp().alias("timestamp"),
        "window_end",
        "cell_id",
        "region",
        F.struct(*FEATURES).alias("input_features"),
        F.struct(
            F.col(code).cast("double").alias("encoded"),
            label_name(F.col(code), labels).alias("label"),
        ).alias("prediction"),
        "event_count",
        "anomaly_event_count",
    )


def score(model: PipelineModel, windows: DataFrame) -> DataFrame:
    return prediction_rows(model.transform(model_inputs(windows)), labels=model_labels(model))
