"""Relations over hexagon ids: points to cells, roll-ups, neighbour means, polygon fill."""

from __future__ import annotations

from math import cos, degrees, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.functions import hexbatch
from hexcast.functions import hexgrid as H
from hexcast.operators.spatial import in_ring, with_edges
from hexcast.session import spread


def with_cells(points: DataFrame, resolution: int, name: str = "hexagon", lat: str = "center_lat", lon: str = "center_lon") -> DataFrame:
    """Add the id of the cell that holds each point; null without a place."""
    return points.withColumn(name, hexbatch.cells_at(F.col(lat), F.col(lon), resolution))


def disk(cells: DataFrame, k: int, cell: str = "hexagon") -> DataFrame:
    """(hexagon, near, distance): every cell at most k steps from each given one, itself at 0.

    Each step looks only at the last ring, and the least distance is kept map-side.
    """
    origin = cells.select(F.col(cell).alias("hexagon")).where(F.col("hexagon").isNotNull()).distinct()
    ring = origin.select("hexagon", F.col("hexagon").alias("near"), F.lit(0).alias("distance"))
    out = ring
    for step in range(1, k + 1):
        ring = ring.select("hexagon", F.explode(H.neighbours_of(F.col("near"))).alias("near")).distinct().withColumn("distance", F.lit(step))
        out = out.unionByName(ring)
    return out.groupBy("hexagon", "near").agg(F.min("distance").alias("distance"))


def ring_mean(rows: DataFrame, value: str, k: int, name: str, cell: str = "hexagon") -> DataFrame:
    """(hexagon, name, neighbours): mean of the value over the cells exactly k steps away that have one; null without any."""
    around = disk(rows, k, cell).where(F.col("distance") == k).select("hexagon", "near")
    met = around.join(rows.select(F.col(cell).alias("near"), F.col(value).alias("__v")), "near")
    mean = met.groupBy("hexagon").agg(F.avg("__v").alias(name), F.count("__v").alias("neighbours"))
    out = rows.select(F.col(cell).alias("hexagon")).join(mean, "hexagon", "left")
    return out.withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))


def grid_step(resolution: int) -> float:
    """Degrees of latitude between points of a square grid that leaves no cell of the resolution without a point.

    A cell's plane is farthest from the sphere at a face's corner, 37.4 degrees from its centre, where lengths shrink most.
    """
    inner = 0.5 * H.UNIT / sqrt(7) ** resolution * cos(37.4 * pi / 180) ** 2
    return degrees(inner) * 1.2


def fill(polygons: DataFrame, keep: list[str], resolution: int) -> DataFrame:
    """(kept columns, hexagon, center_lat, center_lon): the cells whose centre lies in each polygon, holes left out.

    Candidates come from a grid of points over the part of the polygon's own box that lies on the globe and its margin, so a polygon
    costs its box and not the map; rows of the grid are dealt out before their points are made, and each centre is tested against its
    own polygon only. Parts of a multipolygon and overlapping rings follow the even-odd rule; a cell is listed once for each polygon.
    """
    step = grid_step(resolution)
    on_globe = lambda c: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c))
    boxes = with_edges(polygons).select(*keep, "west", "east", "south", "north")
    lines = boxes.withColumn("y", F.explode(F.sequence(F.floor(on_globe(F.col("south")) / step) - 2, F.ceil(on_globe(F.col("north")) / step) + 2)))
    lines = spread(lines.withColumn("lat", on_globe(F.col("y") * step)).drop("south", "north", "y"))
    lines = lines.withColumn("dx", F.least(F.lit(360.0), F.lit(step) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))))
    points = lines.withColumn("x", F.explode(F.sequence(F.floor(F.col("west") / F.col("dx")) - 2, F.ceil(F.col("east") / F.col("dx")) + 2)))
    found = points.select(*keep, hexbatch.cells_at(F.col("lat"), F.col("x") * F.col("dx"), resolution).alias("hexagon")).distinct()
    centre = found.withColumn("at", hexbatch.centres_of(F.col("hexagon"))).select(F.struct(*keep).alias("__from"), "hexagon", F.col("at.lat").alias("center_lat"), F.col("at.lon").alias("center_lon"))
    named = with_edges(polygons).select(F.struct(*keep).alias("__of"), "edges", "west", "east", "south", "north")
    met = centre.join(named, F.col("__of").eqNullSafe(F.col("__from"))).where(F.col("center_lon").between(F.col("west"), F.col("east")) & F.col("center_lat").between(F.col("south"), F.col("north")))
    return met.where(in_ring(F.col("center_lon"), F.col("center_lat"), F.col("edges"))).select("__of.*", "hexagon", "center_lat", "center_lon").distinct()
