"""The registered model queries train the whole job."""

import os

import pytest

from aerolens.operators import forecast, selection
from aerolens.plans import forecasts, jobs
from aerolens.plans.features import training_input

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def test_forecasts_train_all_trees_on_the_selected_columns(spark, monkeypatch):
    seen, train = [], forecast.train_horizons

    def watched(table, features, horizons, **params):
        models = train(table, features, horizons, **params)
        seen.append((features, list(horizons), {len(m.trees) for m in models.values()}, {m.spec.depth for m in models.values()}))
        return models
    monkeypatch.setattr(forecast, "train_horizons", watched)
    table = forecasts.training_table(spark, DATA)
    monkeypatch.setattr(forecasts, "training_table", lambda spark, d: table)
    assert {r["model"] for r in forecasts.gbt_forecast(spark, DATA).collect()} == {"gbt", "persistence"}
    rows = forecasts.gbt_predictions(spark, DATA).collect()
    assert rows and all(len(r["forecast"]) == 24 for r in rows)
    assert seen == [(table[1], list(range(1, 25)), {200}, {6})] * 2
    trials = forecasts.gbt_search(spark, DATA).collect()
    assert len(trials) == 10 and all(r["r2"] <= r["best_r2"] and r["best_trees"] <= r["trees"] for r in trials)


def test_no_selected_column_is_dropped_by_its_place(spark, monkeypatch):
    wide = spark.range(1).selectExpr(*[f"id + {i} AS c{i}" for i in range(200)])
    monkeypatch.setattr(jobs, "engineered_training", lambda *a: (wide, {}))
    for name in ("duplicate_columns", "correlated_columns"):
        monkeypatch.setattr(selection, name, lambda *a: [])
    assert jobs.training_features(wide)[1]["selected"] == wide.columns
    assert jobs.training_features(wide, most=180)[1]["selected"] == wide.columns[:180]


def test_decisions_read_the_written_training_input(spark, monkeypatch):
    class Read(Exception):
        pass

    def watched(table, *a):
        assert table.inputFiles() and all("/training-input-" in f for f in table.inputFiles())
        raise Read
    monkeypatch.setattr(selection, "sparse_columns", watched)
    with pytest.raises(Read):
        jobs.engineered_training(training_input(spark, DATA))
