"""Class weights, standardisation and quality figures, from counts rather than rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MILLI, half_up, to_milli


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``label, weight``: total / (classes * class size); the totals go over the few class rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_classes = Window.partitionBy()
    weight = F.sum("n").over(all_classes) / (F.count(F.lit(1)).over(all_classes) * F.col("n"))
    return counts.select(label, weight.alias("weight"))


def with_class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Each row with the weight of its class; a row without a label is an error, not a row less."""
    missing = F.raise_error(F.lit(f"a row has no {label}"))
    labelled = rows.withColumn(label, F.when(F.col(label).isNotNull(), F.col(label)).otherwise(missing))
    return labelled.join(class_weights(rows, label), label, "left")


def _moments(metrics: Sequence[str]) -> list[Column]:
    """Count, sum and sum of squares in thousandths, exactly."""
    moments = []
    for m in metrics:
        unit = to_milli(F.col(m))
        moments += [
            F.count(m).alias(f"{m}_n"),
            F.sum(unit).alias(f"{m}_s"),
            F.sum((unit * unit).cast("decimal(28,0)")).alias(f"{m}_q"),
        ]
    return moments


def standardised(rows: DataFrame, metrics: Sequence[str], places: int = 6) -> DataFrame:
    """Metrics as (x - mean) / population deviation; a constant metric becomes 0."""
    moments = rows.agg(F.struct(*_moments(metrics)).alias("m")).scalar()
    staged = rows.withColumn("m", moments)
    scaled = {}
    for m in metrics:
        n = F.col(f"m.{m}_n").cast("double")
        mean = F.col(f"m.{m}_s").cast("double") / n
        deviation = F.sqrt(F.greatest(F.col(f"m.{m}_q").cast("double") / n - mean * mean, F.lit(0.0)))
        score = (F.col(m) - mean / MILLI) / F.nullif(deviation / MILLI, F.lit(0.0))
        scaled[m] = F.when(F.col(m).isNotNull(), F.coalesce(half_up(score, places), F.lit(0.0)))
    return staged.withColumns(scaled).drop("m")


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def quality(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from a confusion table."""
    n = F.col("n")
    hit = F.when(F.col(label) == F.col(prediction), n).otherwise(0)
    zero = F.lit(0).cast("bigint")

    def counted(name: str, actual: Column, predicted: Column, right: Column) -> Column:
        return F.struct(
            F.col(name).alias("class"), actual.alias("actual"), predicted.alias("predicted"), right.alias("right")
        )

    sides = F.array(counted(label, n, zero, hit.cast("bigint")), counted(prediction, zero, n, zero))
    per_class = (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "right")])
        .withColumn("precision", F.coalesce(F.col("right") / F.nullif("predicted", F.lit(0)), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.col("right") / F.nullif("actual", F.lit(0)), F.lit(0.0)))
        .withColumn("f1", F.coalesce(F.expr("2 * precision * recall / nullif(precision + recall, 0)"), F.lit(0.0)))
    )
    weighted = [half_up(F.sum(F.col("actual") * F.col(c)) / F.sum("actual"), 6).alias(c) for c in ("precision", "recall", "f1")]
    return per_class.agg(half_up(F.sum("right") / F.sum("actual"), 6).alias("accuracy"), *weighted)
