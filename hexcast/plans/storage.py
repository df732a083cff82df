"""Registered queries over what the sources store: published versions, cubes, polled services; each beside its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hexcast.operators import risk
from hexcast.plans import queries as Q
from hexcast.plans.queries import query
from hexcast.session import shared_folder
from hexcast.sources import cubes, http, snapshots
from hexcast.sources import tables as T
from hexcast.streaming import weekly as stream

EVERYWHERE = (float("-inf"), float("-inf"), float("inf"), float("inf"))  # cells of a large grid lie beyond 90 degrees
HALF = 0.016  # half of a cell's width in degrees, as the viewport takes it


def serving_version(spark, d, path: str) -> snapshots.Snapshot:
    """Publish the cells with their risk, ordered for map views."""
    rows = T.cells(spark, d).join(T.risk_a(spark, d), "cell").select("cell", "district", "state", "center_lon", "center_lat", "a")
    return snapshots.publish(rows, path, "center_lon", "center_lat", "cell", ["a"], rows_per_file=2_000)


@query(Q._viewport_sql(""))
def viewport_snapshot(spark, d):
    """The map view from a published version: only the files that meet the box are opened, and the maximum is the manifest's."""
    at = serving_version(spark, d, f"{shared_folder(spark)}/serving-{uuid.uuid4().hex}")
    near = snapshots.read_box(spark, at, "center_lon", "center_lat", Q.BOX[:4], HALF, above=("a", 0.0))
    out = risk.viewport(near, "a", Q.BOX, float(at.largest["a"] or 1.0))
    return out.select("cell", "district", "state", F.round("a", 4).alias("risk"), "risk_percent")


@query(f"WITH {Q.CELLS}, {Q.RISK_A} SELECT state, count(*) AS hot FROM cells JOIN risk_a USING (cell) WHERE a > (SELECT max(a) FROM risk_a) * 0.9 GROUP BY 1")
def hot_states_snapshot(spark, d):
    """Cells above nine tenths of the stored maximum, by state: files whose own maximum is lower stay closed."""
    at = serving_version(spark, d, f"{shared_folder(spark)}/serving-{uuid.uuid4().hex}")
    hot = snapshots.read_box(spark, at, "center_lon", "center_lat", EVERYWHERE, above=("a", (at.largest["a"] or 0.0) * 0.9))
    return hot.groupBy("state").agg(F.count(F.lit(1)).alias("hot"))


@query(f"WITH {Q.CELLS}, o AS (SELECT o_custkey AS cell, o_orderstatus = 'F' AS f, o_totalprice FROM orders JOIN cells ON cell = o_custkey) SELECT 1 AS version, count(DISTINCT cell) AS cells, round(sum(o_totalprice), 2) AS total FROM o WHERE f UNION ALL SELECT 2, count(DISTINCT cell), round(sum(o_totalprice), 2) FROM o")
def published_versions(spark, d):
    """Two versions of the risk surface, each read as its reader pinned it, after both were published."""
    path = f"{shared_folder(spark)}/serving-{uuid.uuid4().hex}"
    orders = T.table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), "o_orderstatus", "o_totalprice")
    made = []
    for week, rows in enumerate([orders.where("o_orderstatus = 'F'"), orders]):
        surface = T.cells(spark, d).join(rows.groupBy("cell").agg(F.sum("o_totalprice").alias("a")), "cell")
        made.append(snapshots.publish(surface.select("cell", "center_lon", "center_lat", "a"), path, "center_lon", "center_lat", "cell", ["a"], token=f"week-{week}"))
    pinned = [snapshots.snapshot(spark, path, made[0].version), snapshots.snapshot(spark, path)]
    each = [snapshots.read(spark, at).agg(F.lit(at.version).alias("version"), F.count(F.lit(1)).alias("cells"), F.round(F.sum("a"), 2).alias("total")) for at in pinned]
    return each[0].unionByName(each[1])


CUBE = "cube AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 20 AS row, (l_suppkey // 20) % 25 AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3)"


def daily_cube(spark, d):
    """(date, row, col, value): the lines' quantities on a grid of suppliers."""
    key = F.col("l_suppkey")
    place = [(key % 20).cast("int").alias("row"), (F.floor(key / 20) % 25).cast("int").alias("col")]
    return T.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), *place).agg(F.sum("l_quantity").cast("double").alias("value"))


@query(f"WITH {CUBE} SELECT date, count(*) AS cells, sum(value) AS total, max(value) AS largest FROM cube WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-05-31' AND row BETWEEN 4 AND 9 GROUP BY 1")
def cube_window(spark, d):
    """A season of some latitudes from cube files of 32 days: other days and rows of the grid are not read."""
    files = cubes.write_cubes(daily_cube(spark, d), f"{shared_folder(spark)}/cubes-{uuid.uuid4().hex}", (20, 25), 32, -999.0)
    cube = cubes.read_cubes(spark, files, 20, 25, 68.0, 8.0, 0.25, days=8, missing=-999.0)
    season = cube.where("date between date'1995-03-01' and date'1995-05-31' and lat between 9.0 and 10.25 and value is not null")
    return season.groupBy("date").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"), F.max("value").alias("largest"))


BATCH = 50  # places in a request


@query("SELECT s_suppkey AS place, 2 AS readings, round(2 * s_acctbal, 2) AS total FROM supplier", readings="BIGINT")
def polled_readings(spark, d):
    """Every place's readings of two rounds of a poll in batches of 50 places, from answers that stand in the shared folder."""
    path = f"{shared_folder(spark)}/poll-{uuid.uuid4().hex}"
    answer = F.struct(F.col("s_suppkey").alias("place"), F.col("s_acctbal").alias("reading"))
    places = T.table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / BATCH).alias("batch")).agg(F.to_json(F.sort_array(F.collect_list(answer))).alias("value"))
    places.repartition("batch").write.partitionBy("batch").text(f"{path}/answers")
    urls = sorted(spark.read.text(f"{path}/answers").inputFiles())  # one for each batch
    rows = http.poll(spark, urls, f"{path}/store", every=0, rounds=2)
    reading = F.from_json("value", "place long, reading double").alias("r")
    kept = stream.drained(rows.select("request", reading), f"{path}/rows", f"{path}/checkpoint", "append")
    return kept.groupBy("r.place").agg(F.count(F.lit(1)).alias("readings"), F.round(F.sum("r.reading"), 2).alias("total"))
