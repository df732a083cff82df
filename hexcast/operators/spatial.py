"""Neighbour joins, hot-spot statistic, polygons, nearest places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the six axial neighbours, fixed values
RING_1 = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]


def ring(k: int) -> list[tuple[int, int]]:
    """Axial offsets at hexagon distance k."""
    span = range(-k, k + 1)
    return [(q, r) for q in span for r in span if (abs(q) + abs(r) + abs(q + r)) // 2 == k]


def offsets(values: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(q).alias("dq"), F.lit(r).alias("dr")) for q, r in values]))


def neighbours(rows: DataFrame, around: list[tuple[int, int]], carry: list[str]) -> DataFrame:
    """(cell, carried columns of each neighbour): each row is sent to the cells around it, then joined by place.

    An equi-join on (q, r); every row is sent len(around) times, whatever the grid's size.
    """
    sent = rows.select("q", "r", *[F.col(c).alias(f"n_{c}") for c in carry], offsets(around).alias("o"))
    sent = sent.select((F.col("q") - F.col("o.dq")).alias("q"), (F.col("r") - F.col("o.dr")).alias("r"), *[f"n_{c}" for c in carry])
    return rows.select("cell", "q", "r").join(sent, ["q", "r"])


def around_sums(rows: DataFrame, around: list[tuple[int, int]], value: str) -> DataFrame:
    """(q, r, s, n, k): sum and number of the known values around each place, and the number of cells around it.

    What is sent to a place is summed before it meets the place's cell, first within each task, so that the join has one row for a place
    and not one for each neighbour.
    """
    sent = rows.select("q", "r", F.col(value).alias("v"), offsets(around).alias("o"))
    sent = sent.select((F.col("q") - F.col("o.dq")).alias("q"), (F.col("r") - F.col("o.dr")).alias("r"), "v")
    return sent.groupBy("q", "r").agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.count(F.lit(1)).alias("k"))


def ring_mean(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """(cell, name, neighbours): mean of the value over the ring at distance k, null without neighbours."""
    near = around_sums(rows, ring(k), value)
    out = rows.select("cell", "q", "r").join(near, ["q", "r"], "left")
    return out.select("cell", F.try_divide("s", "n").alias(name), F.coalesce("k", F.lit(0).cast("long")).alias("neighbours"))


def gi_star(rows: DataFrame, value: str, k: int = 1) -> DataFrame:
    """(cell, z): Getis-Ord Gi* with binary weights over the cell itself and the rings up to k.

    z is 0 where the value does not vary or the neighbourhood is the whole map.
    """
    around = [(0, 0), *[o for d in range(1, k + 1) for o in ring(d)]]
    near = rows.select("cell", "q", "r").join(around_sums(rows, around, value).select("q", "r", "s", F.col("k").cast("double").alias("k")), ["q", "r"])
    whole = rows.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).cast("double").alias("n"))
    spread = F.col("sd") * F.sqrt((F.col("n") * F.col("k") - F.col("k") * F.col("k")) / F.nullif(F.col("n") - 1.0, F.lit(0.0)))
    z = F.coalesce(F.try_divide(F.col("s") - F.col("m") * F.col("k"), spread), F.lit(0.0))
    return near.join(F.broadcast(whole)).select("cell", z.alias("z"))  # one row


def in_ring(lon: Column, lat: Column, edges: Column) -> Column:
    """Ray casting, half open: edges is an array of (x1, y1, x2, y2) structs."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        at = e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return spans & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def with_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Add edges (of all rings of a polygon with holes, or of all its parts) and the bounding box."""

    def pairs(ring: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(ring) - 1)
        one = lambda i: F.struct(ring[i - 1]["lon"].alias("x1"), ring[i - 1]["lat"].alias("y1"), ring[i]["lon"].alias("x2"), ring[i]["lat"].alias("y2"))
        return F.transform(steps, one)

    edges = F.flatten(F.transform(rings, pairs))
    out = polygons.withColumn("edges", edges)
    for name, part, f in (("west", "lon", F.array_min), ("east", "lon", F.array_max), ("south", "lat", F.array_min), ("north", "lat", F.array_max)):
        out = out.withColumn(name, f(F.expr(f"transform(flatten({rings}), p -> p.{part})")))
    return out


def points_in_polygons(points: DataFrame, polygons: DataFrame, keep: list[str], tile: float = 0.25, lon: str = "center_lon", lat: str = "center_lat") -> DataFrame:
    """Points with the polygons that hold them (none: no row; several: a row each).

    Polygons are exploded over the tiles of their boxes, so the join is an equi-join on tiles with an exact
    test, not a loop over all pairs. By the even-odd rule over all rings, holes are outside and the parts of
    a multipolygon inside.
    """
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)))
    boxes = with_edges(polygons).withColumn("tx", tiles("west", "east")).withColumn("ty", tiles("south", "north"))
    placed = points.withColumn("tx", F.floor(F.col(lon) / tile)).withColumn("ty", F.floor(F.col(lat) / tile))
    near = placed.join(boxes, ["tx", "ty"]).where(F.col(lon).between(F.col("west"), F.col("east")) & F.col(lat).between(F.col("south"), F.col("north")))
    return near.where(in_ring(F.col(lon), F.col(lat), F.col("edges"))).select(*points.columns, *keep)


def nearest(points: DataFrame, places: DataFrame, key: str, place: str, lon: str = "center_lon", lat: str = "center_lat", most: int = 10_000) -> DataFrame:
    """The nearest place of each point by planar degrees, ties by name.

    Places are broadcast behind a check of their number; beyond `most` they are searched by tiles of growing
    size instead, each unplaced point meeting only the nine tiles around it.
    """
    named = places.select(F.col(place), F.col(lon).alias("__x"), F.col(lat).alias("__y"))
    square = lambda x, y: F.round((F.col(lon) - F.col(x)) * (F.col(lon) - F.col(x)) + (F.col(lat) - F.col(y)) * (F.col(lat) - F.col(y)), 12)
    if places.limit(most + 1).count() <= most:
        listed = named.agg(F.collect_list(F.struct(place, "__x", "__y")).alias("__places"))
        each = points.join(F.broadcast(listed))

        def struct(p: Column) -> Column:
            square = (F.col(lon) - p["__x"]) * (F.col(lon) - p["__x"]) + (F.col(lat) - p["__y"]) * (F.col(lat) - p["__y"])
            return F.struct(F.round(square, 12).alias("d"), p[place].alias(place))

        best = F.array_min(F.transform("__places", struct))
        return each.select(*points.columns, best[place].alias(place), F.sqrt(best["d"]).alias("distance"))
    return _nearest_by_tiles(points, named, key, place, lon, lat, square)


def _nearest_by_tiles(points, named, key, place, lon, lat, square) -> DataFrame:
    span = named.agg(F.max("__x") - F.min("__x"), F.max("__y") - F.min("__y"), F.count(F.lit(1))).first()
    size = max(1e-6, (max(span[0], 1e-6) * max(span[1], 1e-6) / span[2]) ** 0.5)
    widest = points.agg(F.max(F.abs(lon)), F.max(F.abs(lat))).first()
    reach = 4 * (max(abs(widest[0] or 0), abs(widest[1] or 0), 1) + span[0] + span[1])
    left, found = points, None
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    while True:
        spread = named.select("*", offsets(around).alias("o"))
        spread = spread.select(place, "__x", "__y", (F.floor(F.col("__x") / size) + F.col("o.dq")).alias("tx"), (F.floor(F.col("__y") / size) + F.col("o.dr")).alias("ty"))
        placed = left.withColumn("tx", F.floor(F.col(lon) / size)).withColumn("ty", F.floor(F.col(lat) / size))
        best = placed.join(spread, ["tx", "ty"]).groupBy(key).agg(F.min(F.struct(square("__x", "__y").alias("d"), F.col(place))).alias("best"))
        sure = best.where((F.sqrt("best.d") <= size) | F.lit(size > reach))
        done = left.join(sure, key).select(*points.columns, f"best.{place}", F.sqrt("best.d").alias("distance"))
        found = done if found is None else found.unionByName(done)
        if size > reach:
            return found
        left, size = left.join(sure, key, "left_anti"), size * 4


def without_match(places: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Places that have no cell."""
    return places.join(cells.select(*keys), keys, "left_anti")


def pixels_in_polygons(pixels: DataFrame, polygons: DataFrame, keep: list[str], half: float) -> DataFrame:
    """Any-touch membership: pixel squares (centre lon, lat) with every polygon that they touch.

    A square touches a polygon if its centre is inside, a vertex lies in it, or an edge crosses a side's
    box; tested as: centre inside, or an edge whose closest box point falls within the square.
    """
    tile = 0.25
    tiles = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - half) / tile), F.floor((F.col(b) + half) / tile)))
    boxes = with_edges(polygons).withColumn("tx", tiles("west", "east")).withColumn("ty", tiles("south", "north"))
    placed = pixels.withColumn("tx", F.floor(F.col("lon") / tile)).withColumn("ty", F.floor(F.col("lat") / tile))
    x, y = F.col("lon"), F.col("lat")

    def meets(e: Column) -> Column:
        # slab clipping of the edge by the square
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = lambda a, d, side: F.try_divide(side - a, d)
        tx1, tx2 = t(e["x1"], dx, x - half), t(e["x1"], dx, x + half)
        ty1, ty2 = t(e["y1"], dy, y - half), t(e["y1"], dy, y + half)
        inx = F.when(dx == 0, (e["x1"] >= x - half) & (e["x1"] <= x + half)).otherwise(F.lit(True))
        iny = F.when(dy == 0, (e["y1"] >= y - half) & (e["y1"] <= y + half)).otherwise(F.lit(True))
        low = F.greatest(F.lit(0.0), F.least(tx1, tx2), F.least(ty1, ty2))
        high = F.least(F.lit(1.0), F.greatest(tx1, tx2), F.greatest(ty1, ty2))
        return inx & iny & (low <= high)

    near = placed.join(boxes, ["tx", "ty"]).where(in_ring(x, y, F.col("edges")) | F.exists("edges", meets))
    return near.select(*pixels.columns, *keep)


def cells_of_polygons(polygons: DataFrame, keep: list[str], width: float = 0.03, west: float = 68.0, south: float = 8.0) -> DataFrame:
    """Axial grid cells whose centre lies in a polygon: (q, r, centre, kept columns), a row per polygon.

    Rows and columns of each polygon's box are generated, so a polygon costs its own box, not the map.
    """
    span = lambda low, high, start: F.sequence(F.floor((F.col(low) - start) / width), F.ceil((F.col(high) - start) / width))
    rows = with_edges(polygons).withColumn("r", F.explode(span("south", "north", south)))
    rows = rows.withColumn("q", F.explode(span("west", "east", west - width)))
    rows = rows.withColumn("center_lon", F.lit(west) + F.lit(width) * F.col("q") + F.lit(width / 2) * F.pmod("r", F.lit(2)))
    rows = rows.withColumn("center_lat", F.lit(south) + F.lit(width) * F.col("r"))
    return rows.where(in_ring(F.col("center_lon"), F.col("center_lat"), F.col("edges"))).select(*keep, "q", "r", "center_lon", "center_lat")
