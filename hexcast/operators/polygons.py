"""Adaptive covers of polygons by quadtree tiles, and dissolving of adjoining polygons into outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcast.operators.spatial import in_ring, with_edges
from hexcast.session import materialised

WORLD = 512.0  # side of the tile at level 0, from -256 to 256 degrees
DEEPEST = 22
EDGES = 12  # a border tile with no more edges is not split
#: where in a tile its inside is known; an odd place, so that it lies on no edge
SPOT = (0.41421356, 0.38196601)


def _side(level: Column) -> Column:
    return F.lit(WORLD) / F.pow(F.lit(2.0), level)


def _corner(level: Column, k: Column) -> Column:
    return k * _side(level) - WORLD / 2


def _spot(level: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    return _corner(level, tx) + _side(level) * SPOT[0], _corner(level, ty) + _side(level) * SPOT[1]


def _meets(e: Column, x0: Column, y0: Column, side: Column) -> Column:
    """Whether an edge meets a tile, its sides included."""
    x1, y1 = x0 + side, y0 + side
    near = (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y1)
    turn = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    sides = [turn(x, y) for x in (x0, x1) for y in (y0, y1)]
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _crossings(edges: Column, fx: Column, fy: Column, x: Column, y: Column) -> Column:
    """Edges crossed on the way from (fx, fy) up or down to y, then along to x; half open as ray casting is."""

    def crossed(e: Column) -> Column:
        at_y = e["y1"] + (fx - e["x1"]) * (e["y2"] - e["y1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))
        up = ((e["x1"] > fx) != (e["x2"] > fx)) & (at_y > F.least(fy, y)) & (at_y <= F.greatest(fy, y))
        at_x = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        along = ((e["y1"] > y) != (e["y2"] > y)) & (at_x > F.least(fx, x)) & (at_x <= F.greatest(fx, x))
        return F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(along, F.lit(False)).cast("int")

    return F.aggregate(F.transform(edges, crossed), F.lit(0), lambda a, n: a + n)


def cover(polygons: DataFrame, keep: list[str], most_edges: int = EDGES, deepest: int = DEEPEST) -> DataFrame:
    """(kept columns, level, tx, ty, edges, inside): tiles that cover each polygon, none of them twice.

    A tile without edges lies inside; a border tile holds only the edges that meet it and whether its spot is inside, so what a point
    is compared with does not grow with the polygon. Tiles begin at the size of the polygon's box and only those with more
    than most_edges edges are split, so a large smooth polygon has few tiles and a small one a few of its own size. By the even-odd
    rule over all rings, holes are outside and parts of a multipolygon inside.
    """
    boxes = with_edges(polygons.select(*keep, "rings"))
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-9))
    level = F.least(F.lit(deepest), F.floor(F.log2(F.lit(WORLD) / extent))).cast("int")
    tiles = boxes.withColumn("level", level)
    span = lambda low, high: F.explode(F.sequence(*[F.floor((F.col(c) + WORLD / 2) / _side(F.col("level"))) for c in (low, high)]))
    tiles = tiles.withColumn("tx", span("west", "east")).withColumn("ty", span("south", "north"))
    tiles = tiles.withColumn("inside", in_ring(*_spot(F.col("level"), F.col("tx"), F.col("ty")), F.col("edges")))

    def own_edges(rows: DataFrame) -> DataFrame:
        at = [_corner(F.col("level"), F.col(c)) for c in ("tx", "ty")]
        rows = rows.withColumn("edges", F.filter("edges", lambda e: _meets(e, *at, _side(F.col("level")))))
        return rows.where((F.size("edges") > 0) | F.col("inside"))

    columns = [*keep, "level", "tx", "ty", "edges", "inside"]
    left, done = materialised(own_edges(tiles).select(*columns)), None
    while True:
        whole = (F.size("edges") <= most_edges) | (F.col("level") >= deepest)
        done = left.where(whole) if done is None else done.unionByName(left.where(whole))
        split = left.where(~whole)
        if not split.limit(1).count():
            return done
        quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a in (0, 1) for b in (0, 1)]))
        split = split.withColumn("k", quarter).withColumn("fx", _spot(F.col("level"), F.col("tx"), F.col("ty"))[0]).withColumn("fy", _spot(F.col("level"), F.col("tx"), F.col("ty"))[1])
        split = split.withColumn("level", F.col("level") + 1).withColumn("tx", F.col("tx") * 2 + F.col("k.x")).withColumn("ty", F.col("ty") * 2 + F.col("k.y"))
        flips = _crossings(F.col("edges"), F.col("fx"), F.col("fy"), *_spot(F.col("level"), F.col("tx"), F.col("ty"))) % 2 == 1
        left = materialised(own_edges(split.withColumn("inside", F.col("inside") != flips)).select(*columns))


def points_in_cover(points: DataFrame, tiles: DataFrame, keep: list[str], lon: str = "center_lon", lat: str = "center_lat") -> DataFrame:
    """Points with the polygons that hold them (none: no row; several: a row each).

    A point is sent to its tile on each level of the cover, of which there are at most DEEPEST, and joined by tile; inside tiles
    need no test, border tiles one over their own few edges.
    """
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())  # at most DEEPEST + 1
    if not levels:
        return points.limit(0).join(tiles.select(*keep).limit(0), F.lit(True))
    named = tiles.select(*keep, *[F.col(c).alias(f"__{c}") for c in ("level", "tx", "ty", "edges", "inside")])
    sent = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    for name, c in (("__tx", lon), ("__ty", lat)):
        sent = sent.withColumn(name, F.floor((F.col(c) + WORLD / 2) / _side(F.col("__level"))))
    met = sent.join(named, ["__level", "__tx", "__ty"])
    flips = _crossings(F.col("__edges"), *_spot(F.col("__level"), F.col("__tx"), F.col("__ty")), F.col(lon), F.col(lat)) % 2 == 1
    return met.where((F.size("__edges") == 0) | (F.col("__inside") != flips)).select(*points.columns, *keep)


def boundary(polygons: DataFrame, group: list[str], digits: int = 9) -> DataFrame:
    """(group, ax, ay, bx, by): the edges that the group's polygons do not share, the inside to their left.

    The first ring of a polygon is its outline and the others are holes, whichever way they run; coordinates are rounded to
    `digits`, so that two polygons' copies of an edge are equal. Edges of no length are left out.
    """
    point = lambda p: F.struct(F.round(p["lon"], digits).alias("x"), F.round(p["lat"], digits).alias("y"))
    rings = polygons.select(*group, F.posexplode("rings").alias("__k", "__ring")).withColumn("__ring", F.transform("__ring", point))
    steps = F.when(F.size("__ring") > 1, F.sequence(F.lit(1), F.size("__ring") - 1)).otherwise(F.array().cast("array<int>"))
    rings = rings.withColumn("__edges", F.transform(steps, lambda i: F.struct(F.col("__ring")[i - 1].alias("a"), F.col("__ring")[i].alias("b"))))
    area = F.aggregate("__edges", F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    turned = (area < 0) != (F.col("__k") > 0)
    edges = rings.select(*group, turned.alias("__turned"), F.explode("__edges").alias("e")).where("e.a <> e.b")
    pick = lambda a, b: F.when(F.col("__turned"), F.col(f"e.{b}")).otherwise(F.col(f"e.{a}"))
    edges = edges.select(*group, pick("a", "b").alias("a"), pick("b", "a").alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    kept = edges.groupBy(*group, low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b")).alias("e"))
    return kept.where("n % 2 = 1").select(*group, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def dissolve(polygons: DataFrame, group: list[str], digits: int = 9) -> DataFrame:
    """(group, ring, area, points): the closed rings around each group's polygons, outlines with a positive area and holes with a negative.

    Shared edges cancel (see boundary()). Every edge left knows the one after it: at its end the sharpest left turn, which keeps rings
    that touch in a point apart. A ring's name and each edge's place in it come from doubling the way to the next edge, in as
    many rounds as the logarithm of the longest ring; no task holds more than one ring, which is one row of the result.
    """
    edges = materialised(boundary(polygons, group, digits))
    edges = materialised(edges.withColumn("id", F.monotonically_increasing_id()))
    out = edges.select(*group, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("next"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("leaves"))
    met = edges.join(out, [*group, "bx", "by"])
    turn = F.pmod(F.col("leaves") - F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")) + F.lit(3 * 3.141592653589793), F.lit(2 * 3.141592653589793))
    links = materialised(met.groupBy("id").agg(F.max_by("next", F.struct(turn, -F.col("next"))).alias("next")))

    # the least edge of each ring
    state = materialised(links.select("id", "next", F.least("id", "next").alias("least")))
    while True:
        there = state.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("least").alias("further"))
        found = materialised(state.join(there, "next").select("id", F.col("beyond").alias("next"), "least", F.least("least", "further").alias("now")))
        if not found.where("now <> least").limit(1).count():
            break
        state = found.select("id", "next", F.col("now").alias("least"))
    named = found.select("id", F.col("now").alias("ring"))

    # the number of edges from each one to its ring's end
    rank = links.join(named, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"))
    rank = materialised(rank.withColumn("far", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    while rank.where("next is not null").limit(1).count():
        there = rank.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("far").alias("more"))
        rank = materialised(rank.join(there, "next", "left").select("id", "ring", F.col("beyond").alias("next"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))

    whole = edges.join(rank.select("id", "ring", "far"), "id")
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    rings = whole.groupBy(*group, "ring").agg((F.sum(cross) / 2).alias("area"), F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("k"), F.col("ax").alias("lon"), F.col("ay").alias("lat")))).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return rings.select(*group, "ring", "area", F.concat(points, F.slice(points, 1, 1)).alias("points"))
