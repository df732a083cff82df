"""Operators on hand-built rows: zero guards, ties, gaps, empty inputs, invariants."""

import json
import struct
import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexcast.functions import exprs as X
from hexcast.operators import alerts, evaluate, explain, models, panel, risk, search, spatial, treeshap
from hexcast.sources import files
from hexcast.sources import tables as T
from hexcast.streaming import weekly


def one(df):
    return df.collect()[0]


def test_percent_of_zero_risk_is_least(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.0)], "cell long, a double")
    assert {r["risk_percent"] for r in risk.with_percent(rows, "a").collect()} == {0.1}
    assert risk.with_percent(rows.limit(0), "a").count() == 0


def test_top_n_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(k, 1.0) for k in (5, 3, 9, 1)], "cell long, a double")
    assert [r["cell"] for r in risk.top_n(rows, "a", 3).collect()] == [1, 3, 5]
    assert one(risk.top_of_group(rows.withColumn("g", F.lit("x")), ["g"], "a"))["cell"] == 1


def test_top_n_plan_has_no_full_sort(spark):
    rows = spark.range(100).select(F.col("id").alias("cell"), F.col("id").cast("double").alias("a"))
    assert "TakeOrderedAndProject" in risk.top_n(rows, "a", 3)._jdf.queryExecution().toString()


def test_box_edges_count_and_reversed_bounds(spark):
    rows = spark.createDataFrame([(1, 70.0, 10.0)], "cell long, center_lon double, center_lat double")
    assert risk.in_box(rows, 70.016, 9, 71, 11).count() == 1
    assert risk.in_box(rows, 70.0161, 9, 71, 11).count() == 0
    assert risk.box_arguments(3, 4, 1, 2, 5) == (1, 2, 3, 4, 100)
    assert risk.box_arguments(1, 2, 3, 4, 10**6)[4] == 25000


def test_chosen_state_prefers_hubs_then_least_mode(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "state string")
    assert rows.agg(risk.chosen_state("state", ["zz"])).first()[0] == "a"
    assert rows.agg(risk.chosen_state("state", ["b"])).first()[0] == "b"


def test_dense_panel_fills_gaps_and_lags_count_weeks(spark):
    rows = spark.createDataFrame([("d", date(2020, 12, 21), 5.0), ("d", date(2021, 1, 11), 7.0)], "district string, monday date, cases double")
    dense = panel.lags(panel.dense_weeks(rows, ["district"], "cases"), ["district"], "cases", [1]).orderBy("monday").collect()
    assert [r["cases"] for r in dense] == [5.0, 0.0, 0.0, 7.0]
    assert [r["cases_lag_1"] for r in dense] == [None, 5.0, 0.0, 0.0]


def test_iso_week_53(spark):
    r = one(spark.range(1).select(X.iso_year(F.lit(date(2021, 1, 1))).alias("y"), X.iso_week(F.lit(date(2021, 1, 1))).alias("w")))
    assert (r["y"], r["w"]) == (2020, 53)


def test_rolling_sees_only_the_past(spark):
    rows = [("d", date(2020, 1, 6 + 7 * k), float(k)) for k in range(3)]
    make = lambda last: panel.rolling_cases(spark.createDataFrame([*rows[:2], ("d", rows[2][1], last)], "district string, monday date, cases double"), ["district"], "cases")
    pick = lambda df: df.orderBy("monday").select("cases_roll_mean_4w", "cases_roll_std_4w").collect()
    assert pick(make(2.0)) == pick(make(900.0))


def test_interpolation_is_linear(spark):
    rows = spark.createDataFrame([("d", 2000, 10.0), ("d", 2004, 30.0)], "district string, year int, population double")
    assert [r["population"] for r in panel.interpolate(rows, ["district"], "year", "population").orderBy("year").collect()] == [10, 15, 20, 25, 30]


def test_mass_is_preserved_even_without_weight(spark):
    rows = spark.createDataFrame([("a", 0.0, 9.0), ("a", 0.0, 9.0), ("b", 1.0, 8.0), ("b", 3.0, 8.0)], "district string, w double, total double")
    sums = panel.mass_preserving(rows, ["district"], "w", "total").groupBy("district").agg(F.sum("share").alias("s"))
    assert {r["district"]: r["s"] for r in sums.collect()} == {"a": 9.0, "b": 8.0}


def test_rings_have_6_and_12_cells_and_are_symmetric():
    for k in (1, 2, 3):
        values = spatial.ring(k)
        assert len(values) == 6 * k and {(-q, -r) for q, r in values} == set(values)


def test_gi_star_of_constant_map_is_zero(spark):
    rows = spark.createDataFrame([(k, k % 4, k // 4, 2.0) for k in range(16)], "cell long, q long, r long, a double")
    assert {r["z"] for r in spatial.gi_star(rows, "a").collect()} == {0.0}
    assert {r["z"] for r in spatial.gi_star(rows.limit(1), "a").collect()} == {0.0}


def test_normal_p_value(spark):
    assert one(spark.range(1).select(X.normal_p_value(F.lit(1.96)).alias("p")))["p"] == pytest.approx(0.0499958, abs=1e-6)


SQUARE = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
HOLE = [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]


def geojson(tmp_path):
    far = [[[x + 5, y] for x, y in SQUARE]]
    shapes = [("p", "Polygon", [SQUARE, HOLE]), ("m", "MultiPolygon", [[SQUARE], far])]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in shapes]}
    (tmp_path / "w.geojson").write_text(json.dumps(body, indent=1))
    return str(tmp_path / "w.geojson")


def test_geojson_polygons_with_holes_and_parts(spark, tmp_path):
    polygons = files.read_polygons(spark, geojson(tmp_path), "name: string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.1, 0.5), (3, 5.5, 0.5), (4, 9.0, 9.0)], "cell long, center_lon double, center_lat double")
    found = spatial.points_in_polygons(points, polygons, ["name"]).collect()
    assert sorted((r["cell"], r["name"]) for r in found) == [(1, "m"), (2, "m"), (2, "p"), (3, "m")]


def test_any_touch_counts_pixels_on_the_border(spark, tmp_path):
    polygons = files.read_polygons(spark, geojson(tmp_path), "name: string").where("name = 'p'")
    pixels = spark.createDataFrame([(1, 1.05, 0.5), (2, 1.2, 0.5), (3, 0.5, 0.5)], "id long, lon double, lat double")
    assert {r["id"] for r in spatial.pixels_in_polygons(pixels, polygons, ["name"], 0.05).collect()} == {1}


@pytest.mark.parametrize("most", [10, 1])
def test_nearest_both_ways(spark, most):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 500.0, -3.0)], "cell long, center_lon double, center_lat double")
    places = spark.createDataFrame([("b", 0.0, 1.0), ("a", 1.0, 0.0), ("c", 9.0, 9.0)], "place string, center_lon double, center_lat double")
    found = spatial.nearest(points, places, "cell", "place", most=most).collect()
    assert {r["cell"]: r["place"] for r in found} == {1: "a", 2: "c", 3: "c"}


def test_raster_reader(spark, tmp_path):
    values = np.array([[1, 2, -9], [4, 5, 6]], "<f4")
    tags = [(256, 4, [3]), (257, 4, [2]), (258, 3, [32]), (259, 3, [1]), (273, 4, [8]), (279, 4, [24]), (339, 3, [3])]
    tail, start = b"", 8 + 24
    extra = [(33550, 12, struct.pack("<3d", 0.5, 0.5, 0)), (33922, 12, struct.pack("<6d", 0, 0, 0, 10, 20, 0)), (42113, 2, b"-9\0")]
    entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v[0], 0) if k == 3 else struct.pack("<I", v[0])) for t, k, v in tags)
    base = start + 2 + 12 * (len(tags) + len(extra)) + 4
    for t, k, raw in extra:
        n = len(raw) // 8 if k == 12 else len(raw)
        entries += struct.pack("<HHI", t, k, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", base + len(tail)))
        tail += b"" if len(raw) <= 4 else raw
    body = b"II*\0" + struct.pack("<I", start) + values.tobytes() + struct.pack("<H", len(tags) + len(extra)) + entries + b"\0\0\0\0" + tail
    (tmp_path / "a.tif").write_bytes(body)
    rows = files.read_rasters(spark, str(tmp_path / "a.tif")).collect()
    assert {(r["row"], r["col"]): r["value"] for r in rows} == {(0, 0): 1, (0, 1): 2, (0, 2): 0, (1, 0): 4, (1, 1): 5, (1, 2): 6}
    assert (rows[0]["lon"], rows[0]["lat"]) == (10.25, 19.75)


def test_grid_cube_reader(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "2020.grd")
    rows = files.read_grid_cube(spark, str(tmp_path / "2020.grd"), 2, 3, 66.5, 6.5, 0.25, lambda p: "2020-01-01").collect()
    assert len(rows) == 12 and max(r["date"] for r in rows) == date(2020, 1, 2) and max(r["value"] for r in rows) == 11


def test_text_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("871", 1.0, 2.0, "d", "s")], files.CELLS)
    files.write_csv(df, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", files.CELLS).collect() == df.collect()
    (tmp_path / "docs.json").write_text(json.dumps([{"h3_index": "x", "daily": {"temperature_2m_max": [1.0, 2.0]}}]))
    assert one(files.read_weather_docs(spark, f"{tmp_path}/docs.json"))["daily"]["temperature_2m_max"] == [1.0, 2.0]
    (tmp_path / "years.json").write_text('["2020", "2021"]')
    assert [r["value"] for r in files.read_strings(spark, f"{tmp_path}/years.json").collect()] == ["2020", "2021"]
    rows = spark.createDataFrame([("a", 1, "{}")], "disease string, horizon int, feature string")
    files.write_features(rows, f"{tmp_path}/out", 2026, 3)
    assert spark.read.json(f"{tmp_path}/out/2026_W03").count() == 1
    files.write_parquet(rows, f"{tmp_path}/pq", "disease")
    files.write_json(rows, f"{tmp_path}/js")
    assert "| a | 1 | {} |" in files.markdown(rows)


def test_serving_table_prunes(spark, data, tmp_path):
    files.write_serving_table(T.cells(spark, data), f"{tmp_path}/serving")
    back = risk.in_box(spark.read.parquet(f"{tmp_path}/serving"), 68.1, 8.05, 68.6, 8.4)
    plan = back._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThanOrEqual(center_lon" in plan


def test_http_source(spark):
    from hexcast.sources.http import JsonHttpSource, place_urls

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"at": self.path}, {"n": 2}] if "1,2" in self.path else {"n": 1}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(JsonHttpSource)
    urls = place_urls(f"http://127.0.0.1:{server.server_port}/?x", [(1, 5), (2, 6), (3, 7)], 2)
    rows = spark.read.format("json_http").option("urls", json.dumps(urls)).load()
    assert rows.count() == 3
    server.shutdown()


def test_alert_rules_in_order(spark):
    rows = spark.createDataFrame([(2.6, "Persistent", 0.0), (2.34, "Intensifying", 0.0), (2.0, "Emerging", 0.0), (0.0, "x", 21.0), (1.7, "x", 0.0), (0.0, "x", 20.0)], "z double, t string, g double")
    assert [r[0] for r in rows.select(X.alert_level("z", "t", "g")).collect()] == [3, 1, 2, 1, 1, 0]
    assert one(spark.range(1).select(X.growth_percent(F.lit(5.0), F.lit(0.0)).alias("g")))["g"] == 0.0


def test_taxonomy(spark):
    series = {"a": [2.5, 2.5, 2.5], "b": [0.0, 0.0, 2.5], "c": [0.0, 2.0, 2.5], "d": [0.0, 2.5, 0.0], "e": [0.0, 0.0, 0.0], "f": [2.5]}
    rows = spark.createDataFrame([(k, w, z) for k, v in series.items() for w, z in enumerate(v)], "cell string, week_index int, z double")
    found = {r["cell"]: r["taxonomy"] for r in alerts.taxonomy(rows, ["cell"]).collect()}
    assert found == {"a": "Persistent", "b": "Emerging", "c": "Intensifying", "d": "Diminishing", "e": "Non-Hotspot", "f": "Emerging"}


def test_confusion_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([(1, False, False)], "h int, actual boolean, predicted boolean")
    r = one(evaluate.confusion(rows, ["h"], "actual", "predicted"))
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["iou"]) == (1, 0, 0, 0, 0)


def test_iou_is_at_most_precision_and_recall(spark, data):
    for r in evaluate.confusion(T.hotspot_flags(spark, data), ["horizon"], "actual", "predicted").collect():
        assert r["iou"] <= min(r["precision"], r["recall"])


def test_regression_guards(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "y double, p double")
    r = one(evaluate.regression_metrics(rows.withColumn("k", F.lit(1)), ["k"], "y", "p"))
    assert r["r2"] is None and r["corr"] == 0.0 and r["mae"] == 1.0


def test_missing_bound_does_not_cover(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (1.0, 1.0, None, 2.0)], "prediction double, actual double, lower_90 double, upper_90 double")
    assert one(evaluate.interval_coverage(rows, [90]))["coverage_90"] == 0.5


def test_nan_is_missing_and_sentinels_are_masked(spark):
    rows = spark.createDataFrame([(float("nan"),), (-999.0,), (3.0,)], "v double")
    assert one(rows.agg(F.max(X.known("v")).alias("m")))["m"] == 3.0
    assert [r[0] for r in rows.select(X.mask_sentinels("v", [-999.0])).collect()][1:] == [None, 3.0]


def test_short_arrays(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "v array<double>")
    assert [r[0] for r in rows.select(X.array_mean(X.tail_slice("v", 7, 0))).collect()] == [2.0, None]
    assert [r[0] for r in rows.select(X.tail_slice("v", 2, 1)).collect()] == [[2.0], []]


def test_hex_parent(spark):
    rows = spark.createDataFrame([("876036b21ffffff",)], "h string")
    assert one(rows.select(X.hex_text(X.hex_parent(X.hex_number("h"), 4)).alias("p")))["p"] == "846036bffffffff"


def test_search_rules(spark):
    rows = spark.createDataFrame([("New Delhi", "Delhi", 5), ("Delhi", "Delhi", 9), ("Delhigarh", "X", 1), ("Adelhi", "X", 2), ("Other", "Delhi", 3)], "district string, state string, cell_count long")
    assert [(r["district"], r["score"]) for r in search.search_districts(rows, " delhi ", 9).collect()] == [("Delhi", 100), ("Delhigarh", 80), ("New Delhi", 70), ("Adelhi", 50), ("Other", 30)]
    assert X.looks_like_cell("87abc") and X.looks_like_cell("abcdef") and not X.looks_like_cell("delhi1")


def test_feature_rules():
    names = ["cases_lag_1", "neighbor_cases_k1_lag1", "rain_lag_1", "sin_week", "frac_built", "dtr_lag_1"]
    assert explain.environmental(names) == ["rain_lag_1", "sin_week", "frac_built", "dtr_lag_1"]
    assert explain.ablation_groups("neighbor_case_mean") == {"Spatial_Neighbors"} and explain.ablation_groups("elevation") == {"Ecology_Population"}
    scenarios = explain.ablation_scenarios(["cases_lag_1", "rain_lag_1", "tmin_lag_1", "sin_week", "frac_built", "dtr", "neighbor_cases"])
    assert scenarios["No Weather"] == ["cases_lag_1", "sin_week", "frac_built", "dtr", "neighbor_cases"]
    assert scenarios["Only Base Cases (No Exogenous)"] == ["cases_lag_1"] and len(scenarios) == 6
    assert [explain.feature_group(n) for n in names] == ["History", "Spatial", "Rain", "Season", "Land", "Misc"]


def test_poisson_fit_recovers_truth(spark):
    rows = models.synthetic_world(spark, 4, 3)
    rows = rows.join(rows.groupBy("district").agg(F.sum("true_cases").alias("total")), "district").withColumn("one", F.lit(1.0)).cache()
    beta = models.poisson_fit(rows, ["district"], "population", ["one", "ndvi", "rainfall"], "total")
    assert np.allclose(beta, [-6.0, 0.8, 0.5], atol=1e-3)


def test_boosted_change_beats_nothing(spark):
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("cases_lag_1"))
    rows = rows.withColumn("y", F.col("cases_lag_1") + F.col("x"))
    model = models.fit_delta(rows, ["x", "absent"], "y", "cases_lag_1", maxIter=5, maxDepth=3)
    scored = models.score_delta(model, rows, ["x", "absent"], "cases_lag_1", "pred")
    assert scored.agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0] < 0.5
    assert scored.agg(F.min("pred")).first()[0] >= 0


def test_stream_matches_batch(spark, data, tmp_path):
    events = T.table(spark, data, "events")
    events.write.parquet(f"{tmp_path}/drop")
    rows = weekly.weekly(weekly.event_stream(spark, f"{tmp_path}/drop", events.schema), ["event_type"], "value")
    got = weekly.drained(rows, f"{tmp_path}/rows", f"{tmp_path}/cp").select("event_type", "monday", "n").collect()
    want = weekly.weekly(events, ["event_type"], "value").select("event_type", "monday", "n").collect()
    assert sorted(got) == sorted(want)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    for k, day in enumerate(["2024-01-02", "2024-03-05", "2024-01-03"]):
        spark.createDataFrame([("a", datetime.fromisoformat(day), 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
        rows = weekly.weekly(weekly.event_stream(spark, f"{tmp_path}/late", spark.read.parquet(f"{tmp_path}/late").schema, 1), ["event_type"], "value")
        query = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/lcp").start(f"{tmp_path}/lout")
        query.awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{tmp_path}/lout").collect()
    assert [(r["monday"], r["n"]) for r in out] == [(date(2024, 1, 1), 1)]


def test_partitions_do_not_change_results(spark, data):
    rows = T.cells(spark, data).join(T.risk_a(spark, data), "cell")
    pick = lambda df: sorted(risk.top_of_group(df.select("district", "state", "cell", "a"), ["district", "state"], "a").collect())
    assert pick(rows) == pick(rows.repartition(7, "cell"))


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_tree_contributions_add_up(spark, kind):
    rows = spark.range(300).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)) / 10.0).alias(f"x{k}") for k in range(4)], F.lit(0.0).alias("base"))
    rows = rows.withColumn("y", F.col("x0") * F.col("x1") + F.when(F.col("x2") > 2, 3.0).otherwise(0.0))
    features = ["x0", "x1", "x2", "x3"]
    params = {"maxIter": 4, "maxDepth": 4} if kind == "gbt" else {"numTrees": 4, "maxDepth": 4}
    model = models.fit_delta(rows, features, "y", "base", kind, **params)
    pdf = model.transform(models.with_missing(rows, features)).toPandas()
    values, expected = treeshap.contributions(treeshap.ensemble_leaves(model.stages[-1]), pdf[features].to_numpy())
    assert np.allclose(values.sum(1) + expected, pdf["__change"])
    long = treeshap.shap_values(model, rows, features, ["id"])
    assert long.count() == 1200 and explain.global_importance(long, []).orderBy("rank").first()["feature"] in ("x0", "x1")
