"""The classifier learns the profiles, keeps the golden vectors, and survives storage."""

from __future__ import annotations

import random

import pytest

from cellhealth.model import scoring, training
from cellhealth.operators.windows import cell_windows
from cellhealth.schemas import FEATURES, GOLDEN_VECTORS, LABELS, PREDICTION_SCHEMA, PROFILES, RUN_SCHEMA, TARGET
from conftest import event


@pytest.fixture(scope="module")
def samples(spark):
    """Samples around the class profiles, uneven in number."""
    rng = random.Random(3)
    sizes = {"excellent": 300, "good": 200, "poor": 100}
    rows = [
        (i, label, *[rng.gauss(mean, sd) for mean, sd in PROFILES[label]])
        for i, label in enumerate(label for label, n in sizes.items() for _ in range(n))
    ]
    return spark.createDataFrame(rows, ["id", TARGET, *FEATURES])


@pytest.fixture(scope="module")
def trained(samples):
    return training.train(samples, ids=["id"], trees=20)


def test_prepared_rows(samples):
    rows = training.prepare(samples, ids=["id"]).toPandas()
    assert len(rows) == 600
    assert rows[rows.is_test].groupby(TARGET).size().to_dict() == {"excellent": 60, "good": 40, "poor": 20}
    assert rows.groupby(TARGET).weight.first().round(9).to_dict() == {"excellent": round(600 / 900, 9), "good": 1.0, "poor": 2.0}
    assert rows[~rows.is_test].fold.between(0, 4).all() and rows[rows.is_test].fold.isna().all()


def test_figures_of_a_run(trained):
    assert trained.labels == list(LABELS)
    assert trained.n_samples == 600
    assert set(trained.metrics) == {"accuracy", "precision", "recall", "f1", "cv_score_mean"}
    assert all(0.95 < v <= 1 for v in trained.metrics.values())


def test_golden_vectors(spark, trained):
    rows = spark.createDataFrame([(*v, w) for v, w in GOLDEN_VECTORS], [*FEATURES, "wanted"])
    found = training.predicted_labels(trained.model, rows).collect()
    assert [r["predicted_label"] for r in found] == [r["wanted"] for r in found]


def test_model_survives_storage(spark, trained, samples, tmp_path):
    training.save(spark, trained, f"{tmp_path}/model", f"{tmp_path}/runs", "first")
    training.save(spark, trained, f"{tmp_path}/model", f"{tmp_path}/runs", "second")
    runs = spark.read.schema(RUN_SCHEMA).parquet(f"{tmp_path}/runs").orderBy("run_name").collect()
    assert [r["run_name"] for r in runs] == ["first", "second"]
    assert runs[0]["metrics"] == trained.metrics and runs[0]["labels"] == list(LABELS)
    loaded = training.load(f"{tmp_path}/model")
    before = trained.model.transform(samples).select("id", "prediction").collect()
    assert loaded.transform(samples).select("id", "prediction").collect() == before


def test_scoring_gives_the_stored_shape(trained, telemetry):
    good = dict(zip(FEATURES, GOLDEN_VECTORS[1][0]))
    scored = scoring.score(trained.model, cell_windows(telemetry([event(0, **good)])))
    assert scored.schema.simpleString() == PREDICTION_SCHEMA.simpleString()
    row = scored.first()
    assert row["prediction"].asDict() == {"encoded": 1.0, "label": "good"}
    assert row["input_features"]["latency_ms"] == 35.0
    assert row["windowed_metrics_id"] == "CELL_0001@2024-03-01T00:00:10.000000Z"


def test_rows_that_miss_a_feature_are_not_scored(trained, telemetry):
    rows = telemetry([event(0), event(1, jitter_ms=None)])
    assert [r["event_id"] for r in scoring.model_inputs(rows).collect()] == [0]


def test_labels_are_the_models_own(spark, samples, tmp_path):
    """Fitted without one class, the codes shift; names and stored predictions must not."""
    two = samples.filter(f"{TARGET} != 'excellent'")
    fitted = training.train(two, ids=["id"], trees=10)
    assert fitted.labels == ["good", "poor"] and fitted.metrics["accuracy"] > 0.9
    training.save(spark, fitted, f"{tmp_path}/model", f"{tmp_path}/runs")
    for model in (fitted.model, training.load(f"{tmp_path}/model")):
        found = training.predicted_labels(model, two).groupBy("predicted_label").count().collect()
        assert {r["predicted_label"] for r in found} == {"good", "poor"}
        rows = spark.createDataFrame([(*v, w) for v, w in GOLDEN_VECTORS[1:]], [*FEATURES, "wanted"])
        stored = rows.selectExpr("*", "'A' as cell_id", "'N' as region", "timestamp '2024-01-01' as window_end", "1L as event_count", "0L as anomaly_event_count")
        assert {r["prediction"]["label"] for r in scoring.score(model, stored).collect()} == {"good", "poor"}
