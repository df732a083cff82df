"""Ids of whole columns equal those of the expressions, pentagons and what is no cell included; work is dealt out."""

import random

from pyspark.sql import functions as F

from hexcast.functions import hexbatch
from hexcast.functions import hexgrid as H
from hexcast.functions.exprs import hex_number
from hexcast.operators import hexcells
from hexcast.plans.hexagons import globe_points
from tests.test_hexgrid import _deg, globe


def test_batches_give_the_ids_and_centres_of_the_expressions(spark):
    rng = random.Random(8)
    near = [(lat + rng.uniform(-4, 4), lon + rng.uniform(-4, 4)) for lat, lon in (_deg(H._on_sphere(f, *c)) for f in range(20) for c in H.CORNERS)]
    points = globe(spark, 60, seed=21).unionByName(spark.createDataFrame(near, "lat double, lon double")).withColumn("res", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = points.select(H.cell_at(F.col("lat"), F.col("lon"), F.col("res")).alias("a"), hexbatch.cells_at(F.col("lat"), F.col("lon"), F.col("res")).alias("b"))
    rows = rows.select("a", "b", H.centre_of(F.col("a")).alias("p"), hexbatch.centres_of(F.col("a")).alias("q")).collect()
    assert len(rows) == 120 * 16 and all(r["a"] == r["b"] for r in rows)
    assert all(abs(r["p"]["lat"] - r["q"]["lat"]) < 1e-9 and abs(r["p"]["lon"] - r["q"]["lon"]) < 1e-9 for r in rows)


def test_what_is_no_cell_or_place_gives_null(spark):
    texts = ["872a1072fffffff", "0", "8f7ffffffffffff", "81083ffffffffff", None, "8009fffffffffff"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", hexbatch.centres_of(hex_number("text")).alias("c"))
    assert [r["text"] for r in rows.collect() if r["c"]] == ["81083ffffffffff", "8009fffffffffff"]
    places = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0)], "lat double, lon double")
    assert [r[0] for r in places.select(hexbatch.cells_at(F.col("lat"), F.col("lon"), 4)).collect()] == [None] * 3


def test_a_small_file_is_dealt_out(spark, data):
    assert globe_points(spark, data).rdd.getNumPartitions() >= 8  # one file of one row group: a single task before


def test_a_box_beyond_the_pole_costs_only_the_globe(spark):
    ring = lambda n: [[{"lon": x, "lat": y} for x, y in ((60.0, 80.0), (90.0, 80.0), (90.0, n), (60.0, n), (60.0, 80.0))]]
    kind = "name string, rings array<array<struct<lon: double, lat: double>>>"
    near, far = ({(r["hexagon"]) for r in hexcells.fill(spark.createDataFrame([("a", ring(n))], kind), ["name"], 4).collect()} for n in (90.0, 2e6))
    assert near and near == far  # 12 million lines of the grid before
