"""Hexagon ids: published ids and outlines, round trips on every resolution, pentagons, neighbours, fill."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hexcast.functions import hexgrid as H
from hexcast.functions.exprs import hex_number, hex_parent, hex_text
from hexcast.operators import hexcells


def ids(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("cell", hex_number("text"))


def test_published_ids_and_outlines(spark):
    known = [(40.689167, -74.044444, 10, "8a2a1072b59ffff"), (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"), (0.0, 0.0, 3, "83754efffffffff")]
    rows = spark.createDataFrame(known, "lat double, lon double, res int, want string")
    assert all(r["got"] == r["want"] for r in rows.select("want", hex_text(H.cell_at(F.col("lat"), F.col("lon"), F.col("res"))).alias("got")).collect())
    outline = [(40.690058601, -74.044151762), (40.689907694, -74.045061792), (40.689270936, -74.045341418), (40.688785091, -74.044711031), (40.688935993, -74.043801021), (40.689572744, -74.043521377)]
    got = ids(spark, ["8a2a1072b59ffff"]).select(H.outline_of(F.col("cell")).alias("o")).first()["o"]
    assert len(got) == 6 and all(abs(p["lat"] - a) < 2e-9 and abs(p["lon"] - b) < 2e-9 for p, (a, b) in zip(got, outline, strict=True))
    centre = ids(spark, ["8928308280fffff"]).select(H.centre_of(F.col("cell")).alias("p")).first()["p"]
    assert (round(centre["lat"], 9), round(centre["lon"], 9)) == (37.776702349, -122.418459323)


def test_cells_of_the_published_predictions_lie_in_their_country(spark):
    texts = ["876036b21ffffff", "873c14583ffffff", "8742cc36affffff", "873d31454ffffff", "8760ad551ffffff", "873ced2eeffffff", "873ca46c1ffffff"]
    rows = ids(spark, texts).withColumn("at", H.centre_of(F.col("cell")))
    rows = rows.select("text", "at.*", H.is_cell(F.col("cell")).alias("ok"), hex_text(H.cell_at(F.col("at.lat"), F.col("at.lon"), 7)).alias("back")).collect()
    assert all(r["ok"] and r["back"] == r["text"] and 6 < r["lat"] < 37 and 68 < r["lon"] < 98 for r in rows)


def test_what_is_no_cell_gives_null(spark):
    rows = ids(spark, ["872a1072fffffff", "0", "8f7ffffffffffff", "81083ffffffffff", None, "8009fffffffffff"])
    rows = rows.select("text", H.is_cell(F.col("cell")).alias("ok"), H.centre_of(F.col("cell")).alias("c"), H.outline_of(F.col("cell")).alias("o"), H.neighbours_of(F.col("cell")).alias("n")).collect()
    assert [r["text"] for r in rows if r["ok"]] == ["81083ffffffffff", "8009fffffffffff"]
    assert all((r["c"] is None) == (r["o"] is None) == (r["n"] is None) == (not r["ok"]) for r in rows)
    place = spark.createDataFrame([(None, 1.0), (1.0, None)], "lat double, lon double")
    assert [r[0] for r in place.select(H.cell_at(F.col("lat"), F.col("lon"), 4)).collect()] == [None, None]


def globe(spark, n, seed=1):
    rng = random.Random(seed)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    return spark.createDataFrame(points, "lat double, lon double").repartition(4)


def test_the_globe_has_122_base_cells_and_842_below(spark):
    rows = globe(spark, 20_000).withColumn("res", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select("res", H.cell_at(F.col("lat"), F.col("lon"), F.col("res")).alias("cell")).distinct().withColumn("five", H.is_pentagon(F.col("cell")))
    found = rows.groupBy("res").agg(F.count(F.lit(1)).alias("n"), F.count_if("five").alias("five"), F.count_if(H.is_cell(F.col("cell"))).alias("ok"))
    assert {(r["res"], r["n"], r["five"], r["ok"]) for r in found.collect()} == {(0, 122, 12, 122), (1, 842, 12, 842)}


def test_round_trips_and_parents_on_every_resolution(spark):
    corners = [_deg(H._on_sphere(f, *c)) for f in range(20) for c in H.CORNERS]
    near = [(lat + dy * 10.0**-k, lon + dx * 10.0**-k) for lat, lon in corners for k in (1, 3) for dx, dy in ((0.31, 0.7), (-0.6, 0.2), (0.1, -0.9))]
    rows = globe(spark, 150, seed=2).unionByName(spark.createDataFrame(near, "lat double, lon double")).withColumn("res", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = rows.select("*", H.cell_at(F.col("lat"), F.col("lon"), F.col("res")).alias("cell")).withColumn("at", H.centre_of(F.col("cell")))
    rows = rows.withColumn("back", H.cell_at(F.col("at.lat"), F.col("at.lon"), F.col("res"))).withColumn("around", H.outline_of(F.col("cell")))
    bad = rows.where((F.col("back") != F.col("cell")) | ~H.is_cell(F.col("cell")) | F.col("cell").isNull()).count()
    assert bad == 0
    size = F.size("around")
    assert rows.where((size != 6) & ~((size == 5) & H.is_pentagon(F.col("cell")))).count() == 0
    finer = rows.where("res = 8").select("cell", hex_parent("cell", 7).alias("up")).withColumn("at", H.centre_of(F.col("up")))
    assert finer.where(H.cell_at(F.col("at.lat"), F.col("at.lon"), 7) != F.col("up")).count() == 0


def _deg(p):
    return math.degrees(math.asin(p[2])), math.degrees(math.atan2(p[1], p[0]))


@pytest.mark.parametrize("res", [0, 1, 4, 7])
def test_neighbours_are_mutual_and_close(spark, res):
    points = globe(spark, 60, seed=res + 3).unionByName(spark.createDataFrame([_deg(H._on_sphere(f, *H.CORNERS[0])) for f in range(20)], "lat double, lon double"))
    cells = points.select(H.cell_at(F.col("lat"), F.col("lon"), res).alias("cell")).distinct()
    pairs = cells.select("cell", H.neighbours_of(F.col("cell")).alias("near"), H.is_pentagon(F.col("cell")).alias("five"))
    assert pairs.where(F.size("near") != F.when(F.col("five"), 5).otherwise(6)).count() == 0
    back = pairs.select("cell", F.explode("near").alias("n")).withColumn("again", H.neighbours_of(F.col("n")))
    assert back.where(~F.array_contains("again", F.col("cell"))).count() == 0


def test_disk_counts(spark):
    cells = globe(spark, 5, seed=9).select(H.cell_at(F.col("lat"), F.col("lon"), 6).alias("hexagon"))
    counts = hexcells.disk(cells.unionByName(cells), 3).groupBy("hexagon", "distance").count().groupBy("distance").agg(F.collect_set("count").alias("n")).collect()
    assert {r["distance"]: r["n"] for r in counts} == {0: [1], 1: [6], 2: [12], 3: [18]}


def test_fill_is_every_cell_whose_centre_is_inside(spark):
    ring = lambda *p: [{"lon": x, "lat": y} for x, y in [*p, p[0]]]
    outer, hole = ring((77.0, 23.0), (77.9, 23.1), (77.6, 23.8), (77.1, 23.6)), ring((77.3, 23.2), (77.5, 23.2), (77.5, 23.4), (77.3, 23.4))
    polygons = spark.createDataFrame([("a", [outer, hole]), ("b", [ring((-0.4, 89.0), (60.0, 88.9), (30.0, 89.3))])], "name string, rings array<array<struct<lon: double, lat: double>>>")
    found = {(r["name"], r["hexagon"]) for r in hexcells.fill(polygons, ["name"], 6).collect()}

    def inside(lon, lat, rings):
        hits = 0
        for r in rings:
            for p, q in zip(r, r[1:]):
                if (p["lat"] > lat) != (q["lat"] > lat) and lon < p["lon"] + (lat - p["lat"]) * (q["lon"] - p["lon"]) / (q["lat"] - p["lat"]):
                    hits += 1
        return hits % 2 == 1

    rng = random.Random(4)
    points = spark.createDataFrame([(rng.uniform(22.9, 23.9), rng.uniform(76.9, 78.0)) for _ in range(20_000)], "lat double, lon double")
    cells = points.select(H.cell_at(F.col("lat"), F.col("lon"), 6).alias("c")).distinct().withColumn("at", H.centre_of(F.col("c"))).collect()
    want = {("a", r["c"]) for r in cells if inside(r["at"]["lon"], r["at"]["lat"], [outer, hole])}
    assert len(want) > 80 and {f for f in found if f[0] == "a"} == want
    assert {f[0] for f in found} == {"a", "b"}
