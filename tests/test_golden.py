"""A published price series and its predictions, where GOLDEN_SERIES and GOLDEN_PREDICTIONS name the CSV files."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.operators import features, models, splits
from tideline.sources.tables import read_series

SERIES, PREDICTIONS = os.environ.get("GOLDEN_SERIES", ""), os.environ.get("GOLDEN_PREDICTIONS", "")
pytestmark = pytest.mark.skipif(not (SERIES and PREDICTIONS), reason="the published series isn't given")
COLUMNS = ["ret_lag_0", "ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "momentum_5", "momentum_20", "volatility_20", "ma_dist_20", "dow_1", "dow_2", "dow_3", "dow_4"]


@pytest.fixture(scope="module")
def rows(spark):
    series = read_series(spark, SERIES, *spark.read.csv(SERIES, header=True).columns[:2])
    return splits.split_rows(features.modeling_rows(features.price_features(series))).cache()


def test_rows_and_splits(rows):
    got = {r.split: r for r in splits.split_summary(rows).collect()}
    assert rows.count() == 1181
    assert (got["train"].n, got["validation"].n, got["test"].n) == (825, 176, 178)
    assert [round(got[s].up_share, 4) for s in ("train", "validation", "test")] == [0.5576, 0.5170, 0.5787]
    assert got["train"].last_date == date(2025, 2, 24)


def test_predictions(spark, rows):
    want = {r.date: r for r in spark.read.csv(PREDICTIONS, header=True, inferSchema=True).collect()}
    got = splits.baselines(rows).where("split = 'test'").collect()
    assert len(got) == len(want) == 178
    assert all((r.y, r.b0_pred, r.b1_pred) == (want[r.date].y_true, want[r.date].B0_pred, want[r.date].B1_pred) for r in got)
    fitted = models.refit_and_predict(rows, COLUMNS, {"C": 1.0, "penalty": "l1", "class_weight": None}, "b2").collect()
    assert all(r.b2_pred == want[r.date].B2_pred for r in fitted)
    assert max(abs(r.b2_proba - want[r.date].B2_proba) for r in fitted) < 2e-3


def test_penalised_intercept(spark, rows):
    import numpy as np

    want = {r.date: r.B2_proba for r in spark.read.csv(PREDICTIONS, header=True, inferSchema=True).collect()}
    table = rows.select("date", "split", "y", *(F.col(c).cast("double") for c in COLUMNS)).toPandas()
    fit, test = table[table.split.isin(["train", "validation"])], table[table.split == "test"]
    mean, std = fit[COLUMNS].mean(), fit[COLUMNS].std(ddof=0)
    w = models.proximal_logistic(((fit[COLUMNS] - mean) / std).to_numpy(), fit["y"].to_numpy(), 1.0)
    p = 1 / (1 + np.exp(-(((test[COLUMNS] - mean) / std).to_numpy() @ w[:-1] + w[-1])))
    assert np.abs(p - np.array([want[d] for d in test["date"]])).max() < 2e-4
