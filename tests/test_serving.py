"""Serving routes, display expressions, exact quantiles and saved models."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hexcast.functions import exprs as X
from hexcast.operators import evaluate, models, risk
from hexcast.plans.queries import QUERIES


def test_requests_are_checked_before_planning():
    assert risk.checked("a", 4) == ("a", 4)
    for bad in (("c", 1), ("a", 0), ("b", 5)):
        with pytest.raises(ValueError, match="unknown|horizon"):
            risk.checked(*bad)


def test_polygon_features_are_closed_rings(spark, data):
    row = QUERIES["geojson_polygons"](spark, data).first()
    found = json.loads(row["feature"])
    ring = found["geometry"]["coordinates"][0]
    assert found["type"] == "Feature" and found["geometry"]["type"] == "Polygon" and len(ring) == 7 and ring[0] == ring[-1]
    assert set(found["properties"]) == {"cell", "district", "state", "risk_percent", "is_aggregate"}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_exact_quantiles(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = np.random.default_rng(4)
        groups = {"x": rng.integers(0, 20, 501).astype(float), "y": rng.random(100), "one": np.array([3.5]), "same": np.ones(40)}
        rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("x", None), ("none", None)], "g string, v double")
        points = [0.0, 0.25, 0.5, 0.95, 1.0]
        found = {r["g"]: r["q"] for r in evaluate.exact_quantiles(rows, "g", "v", points).collect()}
        assert set(found) == set(groups)
        for g, vs in groups.items():
            assert found[g] == pytest.approx(np.quantile(vs, points).tolist())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_models_are_saved_with_their_features(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), float(k % 3), 2.0 * k - k % 3) for k in range(20)], "b double, a double, y double")
    features = ["b", "a"]
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(labelCol="y")]).fit(rows)
    models.save(model, features, f"file://{tmp_path}/m")
    again, names = models.load(spark, f"file://{tmp_path}/m")
    assert names == features
    assert [r[0] for r in again.transform(rows).select("prediction").collect()] == [r[0] for r in model.transform(rows).select("prediction").collect()]


def test_colour_stops_are_met(spark):
    rows = spark.createDataFrame([(-5.0,), (0.0,), (12.5,), (25.0,), (60.0,), (75.0,), (100.0,), (120.0,)], "p double")
    got = [tuple(r[0]) for r in rows.select(X.risk_colour("p")).collect()]
    assert got[0] == got[1] == (59, 130, 246) and got[3] == (34, 197, 94) and got[5] == (239, 68, 68) and got[6] == got[7] == (153, 27, 27)
    assert got[2] == (47, 164, 170)


def test_labels_of_keys(spark):
    rows = spark.createDataFrame([("cases_lag_1",), ("x",), ("",), (None,)], "k string")
    assert [r[0] for r in rows.select(X.label_of("k")).collect()] == ["Cases", "X", "", None]


def test_no_horizon_is_left_out(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell int")
    some = spark.createDataFrame([(1, 1, 5.0), (2, 1, 10.0), (1, 2, 0.0)], "cell int, horizon int, v double")
    got = risk.at_all_horizons(cells, some, "v", [1, 2, 3]).orderBy("horizon", "cell").select("v", F.round("risk_percent", 3)).collect()
    assert [tuple(r) for r in got] == [(5.0, 49.95), (10.0, 99.9), *[(0.0, 0.1)] * 4]


def test_hot_states_count_cells_beyond_ninety_degrees(spark, data, tmp_path):
    from hexcast.plans.storage import hot_states_snapshot

    for t in ("nation", "region", "customer", "orders"):
        rows = spark.read.parquet(f"{data}/{t}.parquet")
        key = {"customer": "c_custkey", "orders": "o_custkey"}.get(t)
        if key:  # rows of the grid from 3,000 on, which are at 98 degrees and more
            rows = rows.unionByName(rows.withColumn(key, F.col(key) + 120_000))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    once = {r["state"]: r["hot"] for r in hot_states_snapshot(spark, data).collect()}
    assert {r["state"]: r["hot"] for r in hot_states_snapshot(spark, str(tmp_path)).collect()} == {s: 2 * n for s, n in once.items()}


def test_training_panel_is_written_once(spark, data):
    from hexcast.plans.queries import training_panel

    files = training_panel(spark, data).inputFiles()
    assert files and not any("orders" in f or "customer" in f for f in files)  # each pass of a fit joined the orders again
