"""Covers against ray casting, dissolved outlines against brute force, and the place index."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hexcast.operators import places, polygons

RINGS = "array<array<struct<lon: double, lat: double>>>"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in [*points, points[0]]]


def inside(lon, lat, rings):
    hits = 0
    for r in rings:
        for p, q in zip(r, r[1:]):
            if (p["lat"] > lat) != (q["lat"] > lat) and lon < p["lon"] + (lat - p["lat"]) * (q["lon"] - p["lon"]) / (q["lat"] - p["lat"]):
                hits += 1
    return hits % 2 == 1


def wave(x, y, size, n):
    return ring(*[(x + size * (1 + 0.3 * math.sin(9 * a)) * math.cos(a), y + size * (1 + 0.3 * math.sin(9 * a)) * math.sin(a)) for a in (2 * math.pi * k / n for k in range(n))])


def test_cover_finds_what_ray_casting_finds(spark):
    shapes = {
        "waves": [wave(10, 10, 3, 700), wave(10, 10, 1, 90)],
        "grid aligned": [ring((0, 0), (8, 0), (8, 8), (0, 8)), ring((2, 2), (4, 2), (4, 4), (2, 4))],
        "parts": [wave(3, 12, 0.5, 40), wave(15, 4, 2, 300)],
        "tiny": [wave(9.3, 3.3, 1e-5, 30)],
        "no area": [ring((1, 1), (2, 2))],
    }
    areas = spark.createDataFrame(list(shapes.items()), f"name string, rings {RINGS}")
    tiles = polygons.cover(areas, ["name"])
    sizes = tiles.select("name", F.size("edges").alias("n"), "level")
    assert sizes.where("n > 12 and level < 22").count() == 0
    tiny = sizes.where("name = 'tiny'").count()
    assert 0 < tiny < 100 and sizes.where("n = 0").count() > 20 and sizes.count() < 3000
    rng = random.Random(2)
    points = [(k, rng.uniform(-1, 18), rng.uniform(-1, 18)) for k in range(3000)]
    points += [(k, float(x), float(y)) for k, (x, y) in enumerate([(x, y) for x in range(0, 9) for y in range(0, 9)], 3000)] + [(4000, 9.3, 3.3)]
    got = polygons.points_in_cover(spark.createDataFrame(points, "id long, center_lon double, center_lat double"), tiles, ["name"])
    want = {(k, name) for k, x, y in points for name, rings in shapes.items() if inside(x, y, rings)}
    assert {(r["id"], r["name"]) for r in got.collect()} == want and got.count() == len(want)


def test_cover_of_nothing(spark):
    none = spark.createDataFrame([], f"name string, rings {RINGS}")
    points = spark.createDataFrame([(1, 1.0, 1.0)], "id long, center_lon double, center_lat double")
    assert polygons.points_in_cover(points, polygons.cover(none, ["name"]), ["name"]).count() == 0


def square(x, y, turned):
    corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    return [ring(*(corners[::-1] if turned else corners))]


def test_dissolved_squares(spark):
    rng = random.Random(3)
    sets = {g: {(x, y) for x in range(9) for y in range(9) if rng.random() < 0.6} for g in range(4)}
    sets[9] = {(0, 0), (1, 1), (2, 0)}  # touching in points
    sets[10] = {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    sets[11] = {(x, 0) for x in range(300)}
    rows = [(g, square(x, y, (x + y) % 2 == 0)) for g, cells in sets.items() for x, y in cells]
    found = polygons.dissolve(spark.createDataFrame(rows, f"grp long, rings {RINGS}"), ["grp"]).collect()
    for g, cells in sets.items():
        own = [r for r in found if r["grp"] == g]
        assert sum(r["area"] for r in own) == len(cells)
        edges = {frozenset(e) for x, y in cells for e in (((x, y), (x + 1, y)), ((x, y), (x, y + 1)), ((x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1)))}
        lone = {e for e in edges if sum((x, y) in cells for x, y in _beside(e)) == 1}
        walked = [frozenset([(p["lon"], p["lat"]), (q["lon"], q["lat"])]) for r in own for p, q in zip(r["points"], r["points"][1:])]
        assert len(walked) == len(set(walked)) and set(walked) == lone
        assert all(r["points"][0] == r["points"][-1] for r in own)
        assert sum(r["area"] > 0 for r in own) == _parts(cells)
    assert sorted(r["area"] for r in found if r["grp"] == 9) == [1.0, 1.0, 1.0]
    assert sorted(r["area"] for r in found if r["grp"] == 10) == [-1.0, 9.0]


def _beside(edge):
    (ax, ay), (bx, by) = sorted(edge)
    return [(ax, ay), (ax, ay - 1)] if ay == by else [(ax, ay), (ax - 1, ay)]


def _parts(cells):
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
    return n


def test_dissolve_keeps_holes_and_drops_nothing_edges(spark):
    outer, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 2), (2, 2), (2, 1))
    rows = [("a", [outer, hole]), ("a", [ring((4, 0), (6, 0), (6, 4), (4, 4))]), ("b", [ring((1, 1), (1, 1))]), ("c", [[]])]
    found = polygons.dissolve(spark.createDataFrame(rows, f"grp string, rings {RINGS}"), ["grp"]).collect()
    assert sorted((r["grp"], r["area"]) for r in found) == [("a", -1.0), ("a", 24.0)]


@pytest.mark.parametrize("query", ["ab", "abc", "Cab a", " b", "zzzz", "a", "cabc"])
def test_index_finds_every_name_that_holds_the_query(spark, tmp_path, query):
    rng = random.Random(5)
    names = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3))) for _ in range(400)] + ["", None, "Ab", "x"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, name string")
    places.write_index(rows, f"file://{tmp_path}/i", ["name"], files=4)
    found = {r["id"] for r in places.candidates(spark, f"file://{tmp_path}/i", query).collect()}
    q = query.strip().lower()
    want = {k for k, n in enumerate(names) if n and q in n.lower()}
    assert want <= found and len(found) <= 2 * len(want) + 5
