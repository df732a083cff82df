"""Registered queries of polygon covers, any-touch rollups, dissolved outlines and the place index, each beside its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hexcast.operators import places, polygons, search, spatial
from hexcast.plans import queries as Q
from hexcast.plans.queries import CELLS, query
from hexcast.plans.storage import CUBE, daily_cube
from hexcast.session import shared_folder
from hexcast.sources import tables as T

CORNERS = 60
STARS = f"""{CELLS}, star AS (SELECT district, round(avg(center_lon), 4) AS x, round(avg(center_lat), 4) AS y FROM cells GROUP BY 1),
spoke AS (SELECT district, k, x + (CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.2 END)::DOUBLE * cos(radians(6.0::DOUBLE * k + 1)) AS px, y + (CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.2 END)::DOUBLE * sin(radians(6.0::DOUBLE * k + 1)) AS py FROM star, range(0, {CORNERS + 1}) t(k)),
edge AS (SELECT a.district, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM spoke a JOIN spoke b ON a.district = b.district AND b.k = a.k + 1)"""


def stars(spark, d):
    """A star of sixty corners around the middle of each district's cells."""
    middle = T.cells(spark, d).groupBy("district").agg(F.round(F.avg("center_lon"), 4).alias("x"), F.round(F.avg("center_lat"), 4).alias("y"))

    def corner(k):
        far = F.when(k % 2 == 0, 0.5).otherwise(0.2)
        return F.struct((F.col("x") + far * F.cos(F.radians(k * 6.0 + 1))).alias("lon"), (F.col("y") + far * F.sin(F.radians(k * 6.0 + 1))).alias("lat"))

    return middle.select(F.col("district").alias("star"), F.array(F.transform(F.sequence(F.lit(0), F.lit(CORNERS)), corner)).alias("rings"))


@query(f"WITH {STARS}, hit AS (SELECT e.district AS star, cell FROM cells, edge e WHERE (y1 > center_lat) <> (y2 > center_lat) AND center_lon < x1 + (center_lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT star, count(*) AS cells, sum(cell) AS mixed FROM hit GROUP BY 1", mixed="BIGINT")
def covered_points(spark, d):
    """Cells within each district's star, through the stars' tiles."""
    tiles = polygons.cover(stars(spark, d), ["star"])
    hits = polygons.points_in_cover(T.cells(spark, d).select("cell", "center_lon", "center_lat"), tiles, ["star"])
    return hits.groupBy("star").agg(F.count(F.lit(1)).alias("cells"), F.sum("cell").alias("mixed"))


HALF = 0.125
BOXES = "box AS (SELECT district, min(center_lon) + 0.0101 AS w, max(center_lon) - 0.0103 AS e, min(center_lat) + 0.0107 AS s, max(center_lat) - 0.0109 AS n FROM cells GROUP BY 1)"


@query(f"WITH {CELLS}, {BOXES}, {CUBE}, touch AS (SELECT district, date, value FROM cube, box WHERE 68 + 0.25::DOUBLE * col + {HALF} >= w AND 68 + 0.25::DOUBLE * col - {HALF} <= e AND 8 + 0.25::DOUBLE * row + {HALF} >= s AND 8 + 0.25::DOUBLE * row - {HALF} <= n) SELECT district, date, count(*) AS pixels, round(avg(value), 6) AS mean FROM touch GROUP BY 1, 2")
def any_touch_weather(spark, d):
    """Daily means over the grid squares that touch each district's area: a square counts for every district that it touches."""
    box = T.cells(spark, d).groupBy("district").agg(
        (F.min("center_lon") + 0.0101).alias("w"), (F.max("center_lon") - 0.0103).alias("e"), (F.min("center_lat") + 0.0107).alias("s"), (F.max("center_lat") - 0.0109).alias("n"),
    )
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    areas = box.where("w < e and s < n").select("district", F.array(ring).alias("rings"))
    cube = daily_cube(spark, d).where("value is not null")
    squares = cube.select("row", "col").distinct().withColumn("lon", 68 + 0.25 * F.col("col")).withColumn("lat", 8 + 0.25 * F.col("row"))
    members = spatial.pixels_in_polygons(squares, areas, ["district"], HALF).select("row", "col", "district").distinct()
    return cube.join(members, ["row", "col"]).groupBy("district", "date").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS nation, c_custkey % 40 AS q, c_custkey // 40 AS r FROM customer),
pair AS (SELECT x.nation, count(*) AS shared FROM c x JOIN c y ON x.nation = y.nation AND ((y.q = x.q + 1 AND y.r = x.r) OR (y.q = x.q AND y.r = x.r + 1)) GROUP BY 1),
n AS (SELECT nation, count(*) AS squares FROM c GROUP BY 1)
SELECT nation, CAST(squares AS DOUBLE) AS area, 4 * squares - 2 * coalesce(shared, 0) AS edges FROM n LEFT JOIN pair USING (nation)""")
def dissolved_areas(spark, d):
    """Area and number of edges of the outlines around each nation's squares of the grid, after shared edges cancelled."""
    rows = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 40).alias("q"), F.floor(F.col("c_custkey") / 40).alias("r")).distinct()
    corner = lambda x, y: F.struct((F.col("q") + x).cast("double").alias("lon"), (F.col("r") + y).cast("double").alias("lat"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    rings = polygons.dissolve(rows.select("nation", F.array(ring).alias("rings")), ["nation"])
    return rings.groupBy("nation").agg(F.sum("area").alias("area"), F.sum(F.size("points") - 1).alias("edges"))


@query(Q.ORACLES["search_districts"])
def search_districts_indexed(spark, d):
    """The district search through the stored index: only postings of the query's letters and the places that they name are read."""
    path = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    places.write_index(search.district_index(T.cells(spark, d)), path, ["district", "state"])
    return search.search_districts(places.candidates(spark, path, " Nation_1 "), " Nation_1 ", 8)


@query("SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'd wid')")
def parts_named_indexed(spark, d):
    """Part names that hold a text, through the stored index of names."""
    path = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    places.write_index(T.table(spark, d, "part").select("p_name").distinct(), path, ["p_name"])
    return places.candidates(spark, path, "d wid").where(F.lower("p_name").contains("d wid"))
