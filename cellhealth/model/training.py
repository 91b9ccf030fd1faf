"""Fit and evaluate the health classifier with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_name
from ..operators.evaluate import confusion, quality, with_class_weights
from ..operators.sampling import SEED, cross_validation_folds, stratified_split
from ..schemas import FEATURES, RUN_SCHEMA, TARGET
from ..session import checkpoint_root
from .scoring import model_labels

# Forest size and limits.
TREES = 100
MAX_DEPTH = 10
MIN_LEAF = 5
FOLDS = 5


@dataclass
class TrainedModel:
    model: PipelineModel
    labels: list[str]
    metrics: dict[str, float]
    n_samples: int
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


def as_doubles(rows: DataFrame, metrics: Sequence[str] = FEATURES) -> DataFrame:
    return rows.withColumns({m: F.col(m).cast("double") for m in metrics})


def classifier(trees: int = TREES, seed: int = SEED) -> Pipeline:
    """Label codes in alphabetical order, scaled features, weighted forest."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=TARGET, outputCol="code", stringOrderType="alphabetAsc", handleInvalid="error"),
            VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True),
            RandomForestClassifier(
                featuresCol="scaled_features",
                labelCol="code",
                weightCol="weight",
                numTrees=trees,
                maxDepth=MAX_DEPTH,
                minInstancesPerNode=MIN_LEAF,
                seed=seed,
            ),
        ]
    )


def predicted_labels(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("predicted_label", label_name(F.col("prediction"), model_labels(model)))


def prepare(samples: DataFrame, ids: Sequence[str] = ("cell_id", "window_end"), seed: int = SEED) -> DataFrame:
    """Samples with ``weight``, ``is_test`` and ``fold``; the weights count all rows.

    ``ids`` identify a sample. A forest reads its input once per level, so the prepared rows are
    checkpointed: they are neither derived again nor lost with an executor.
    """
    checkpoint_root(samples.sparkSession)
    weighted = with_class_weights(as_doubles(samples), TARGET)
    parts = stratified_split(weighted, TARGET, ids, seed=seed).checkpoint()
    training = cross_validation_folds(parts.filter(~F.col("is_test")), TARGET, ids, FOLDS, seed + 1)
    testing = parts.filter("is_test").withColumn("fold", F.lit(None).cast("int"))
    return training.unionByName(testing).checkpoint()


def fit(prepared: DataFrame, trees: int = TREES, seed: int = SEED) -> PipelineModel:
    """One fit on the training part."""
    return classifier(trees, seed).fit(prepared.filter(~F.col("is_test")))


def cross_validated(prepared: DataFrame, trees: int = TREES, seed: int = SEED) -> tuple[PipelineModel, float]:
    """The model fitted on the whole training part, and its mean accuracy over the folds."""
    search = CrossValidator(
        estimator=classifier(trees, seed),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="code", metricName="accuracy"),
        numFolds=FOLDS,
        foldCol="fold",
        parallelism=FOLDS,
    )
    fitted = search.fit(prepared.filter(~F.col("is_test")))
    return fitted.bestModel, float(fitted.avgMetrics[0])


def evaluate(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    """Accuracy, precision, recall and F1 from one pass: only the confusion table is collected."""
    pairs = confusion(predicted_labels(model, rows), TARGET, "predicted_label")
    return quality(pairs, TARGET, "predicted_label").first().asDict()


def train(
    samples: DataFrame, ids: Sequence[str] = ("cell_id", "window_end"), trees: int = TREES, seed: int = SEED
) -> TrainedModel:
    """Split, weigh, cross-validate and fit on the training part, evaluate on the rest."""
    rows = prepare(samples, ids, seed)
    model, accuracy = cross_validated(rows, trees, seed)
    figures = evaluate(model, rows.filter("is_test"))
    figures["cv_score_mean"] = accuracy
    return TrainedModel(model, model_labels(model), figures, rows.count())


def save(spark: SparkSession, trained: TrainedModel, model_path: str, runs_path: str, run_name: str | None = None) -> None:
    """Store the fitted stages and append one row to the table of runs."""
    trained.model.write().overwrite().save(model_path)
    started = trained.started_at
    record = (
        run_name or f"cell-health {started.isoformat(timespec='seconds')}",
        started,
        {"estimator": "weighted forest"},
        {"inputs": " ".join(FEATURES), "rows": str(trained.n_samples), "weights": "total / (classes * class size)"},
        trained.metrics,
        trained.labels,
        model_path,
    )
    spark.createDataFrame([record], RUN_SCHEMA).write.mode("append").parquet(runs_path)


def load(model_path: str) -> PipelineModel:
    return PipelineModel.load(model_path)
