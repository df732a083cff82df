"""Registered queries over hexagon ids, with SQL that works the same ids out from the faces' tables."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

from pyspark.sql import functions as F

from hexcast.functions import hexbatch
from hexcast.functions import hexgrid as H
from hexcast.functions.exprs import hex_parent, hex_text
from hexcast.operators import hexcells
from hexcast.plans.queries import CELLS, RISK_A, query
from hexcast.session import spread
from hexcast.sources import tables as T

# ---- SQL ---------------------------------------------------------------------------------------


def values(rows: list, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(f'{v!r}::DOUBLE' if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)}) t({names})"


FACES = f"faces AS (SELECT * FROM {values([(f, *map(float, c), *map(float, u), *map(float, v)) for f, (c, u, v) in enumerate(H.AXES)], 'face, cx, cy, cz, ux, uy, uz, vx, vy, vz')})"
SPOTS = f"spots AS (SELECT * FROM {values([(f, i, j, b, t) for (f, i, j), (b, t) in H.LOOKUP.items() if b not in H.RINGS], 'face, i, j, base, turn')})"
HOMES = f"homes AS (SELECT * FROM {values([(b, H.HOMES[b], i, j) for b, (i, j, p) in enumerate(H.HOME) if not p], 'base, face, i, j')})"
EDGES = f"edges AS (SELECT * FROM {values([(f, e, g, t * pi / 3, x, y) for (f, e), (g, t, x, y) in H.EDGES.items()], 'face, edge, across, turn, dx, dy')})"
TURNS, _row = [], list(range(7))
for _ in range(6):
    TURNS += _row
    _row = [H.NEXT[d] for d in _row]


def cells_sql(name: str, source: str, res: int) -> str:
    """CTEs ending in {name} (key, hexagon): the ids of source's (key, lat, lon) outside of pentagons' base cells."""
    odd, size = res % 2, sqrt(7) ** res / H.UNIT
    a = -H.TURN if odd else 0.0
    out = f"""{name}_p AS (SELECT key, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {source}),
{name}_f AS (SELECT key, max_by({{'face': face, 'c': x * cx + y * cy + z * cz, 'u': x * ux + y * uy + z * uz, 'v': x * vx + y * vy + z * vz}}, x * cx + y * cy + z * cz) AS f FROM {name}_p, faces GROUP BY key),
{name}_q AS (SELECT key, f.face AS face, (f.u * {cos(a)!r}::DOUBLE - f.v * {sin(a)!r}::DOUBLE) * {size!r}::DOUBLE / f.c AS x, (f.u * {sin(a)!r}::DOUBLE + f.v * {cos(a)!r}::DOUBLE) * {size!r}::DOUBLE / f.c / {sqrt(3) / 2!r}::DOUBLE AS b FROM {name}_f),
{name}_r AS (SELECT key, face, x - b / 2 AS q, b AS r, floor(x - b / 2 + 0.5) AS rq, floor(b + 0.5) AS rr, floor(-x - b / 2 + 0.5) AS rs FROM {name}_q),
{name}_s AS (SELECT *, abs(rq - q) AS da, abs(rr - r) AS db, abs(rs + q + r) AS dc FROM {name}_r),
{name}_{res} AS (SELECT key, face, CAST(CASE WHEN da > db AND da > dc THEN -rs WHEN db >= da AND db > dc THEN -rs ELSE rq + rr END AS BIGINT) AS i, CAST(CASE WHEN db > dc AND NOT (da > db AND da > dc) THEN -rq - rs ELSE rr END AS BIGINT) AS j, CAST([] AS BIGINT[]) AS digits FROM {name}_s)"""
    for r in range(res, 0, -1):
        up = ("3 * i - j", "i + 2 * j") if r % 2 else ("2 * i + j", "3 * j - i")
        down = ("2 * ni + nj", "3 * nj - ni") if r % 2 else ("3 * ni - nj", "ni + 2 * nj")
        out += f""", {name}_u{r} AS (SELECT *, CAST(floor(({up[0]}) / 7.0 + 0.5) AS BIGINT) AS ni, CAST(floor(({up[1]}) / 7.0 + 0.5) AS BIGINT) AS nj FROM {name}_{r}),
{name}_d{r} AS (SELECT *, i - ({down[0]}) AS di, j - ({down[1]}) AS dj, least(i - ({down[0]}), j - ({down[1]}), 0) AS low FROM {name}_u{r}),
{name}_{r - 1} AS (SELECT key, face, ni AS i, nj AS j, list_prepend((di - low) * 4 + (dj - low) * 2 - low, digits) AS digits FROM {name}_d{r})"""
    digits = f"list_sum(list_transform(digits, lambda d, k: {TURNS}[turn * 7 + d + 1] * (1::BIGINT << CAST(45 - 3 * k AS INTEGER))))"
    rest = (1 << 59) + (res << 52) + (1 << 45 - 3 * res) - 1
    return out + f", {name} AS (SELECT key, CAST({rest} + base * {1 << 45} + coalesce({digits}, 0) AS BIGINT) AS hexagon FROM {name}_0 JOIN spots USING (face, i, j))"


def centres_sql(name: str, source: str, res: int) -> str:
    """CTEs ending in {name} (hexagon, lat, lon) of source's ids outside of pentagons' base cells."""
    out = f"{name}_0 AS (SELECT hexagon, h.face, h.i::BIGINT AS i, h.j::BIGINT AS j FROM {source} JOIN homes h ON h.base = (hexagon >> 45) & 127)"
    for r in range(1, res + 1):
        down = ("2 * i + j", "3 * j - i") if r % 2 else ("3 * i - j", "i + 2 * j")
        digit = f"((hexagon >> {45 - 3 * r}) & 7) + 1"
        out += f", {name}_{r} AS (SELECT hexagon, face, {down[0]} + {[i for i, _ in H.STEPS]}[{digit}] AS i, {down[1]} + {[j for _, j in H.STEPS]}[{digit}] AS j FROM {name}_{r - 1})"
    a, size = (H.TURN if res % 2 else 0.0), sqrt(7) ** -res
    past = [f"(x * {cos(pi / 3 + 2 * pi / 3 * e)!r}::DOUBLE + y * {sin(pi / 3 + 2 * pi / 3 * e)!r}::DOUBLE)" for e in range(3)]
    return out + f""", {name}_x AS (SELECT hexagon, face, (i - j / 2.0::DOUBLE) AS a, j * {sqrt(3) / 2!r}::DOUBLE AS b FROM {name}_{res}),
{name}_y AS (SELECT hexagon, face, (a * {cos(a)!r}::DOUBLE - b * {sin(a)!r}::DOUBLE) * {size!r}::DOUBLE AS x, (a * {sin(a)!r}::DOUBLE + b * {cos(a)!r}::DOUBLE) * {size!r}::DOUBLE AS y FROM {name}_x),
{name}_z AS (SELECT *, CASE WHEN greatest({', '.join(past)}) > 1 THEN list_position([{', '.join(past)}], greatest({', '.join(past)})) - 1 END AS edge FROM {name}_y),
{name}_e AS (SELECT hexagon, coalesce(e.across, z.face) AS face, CASE WHEN e.across IS NULL THEN x ELSE x * cos(turn) - y * sin(turn) + dx END AS x, CASE WHEN e.across IS NULL THEN y ELSE x * sin(turn) + y * cos(turn) + dy END AS y FROM {name}_z z LEFT JOIN edges e ON e.face = z.face AND e.edge = z.edge),
{name}_v AS (SELECT hexagon, {', '.join(f"c{k} + (x * u{k} + y * v{k}) * {H.UNIT!r}::DOUBLE AS p{k}" for k in 'xyz')} FROM {name}_e JOIN faces USING (face)),
{name} AS (SELECT hexagon, degrees(atan2(pz, sqrt(px * px + py * py))) AS lat, degrees(atan2(py, px)) AS lon FROM {name}_v)"""


TABLES = f"{FACES}, {SPOTS}, {HOMES}, {EDGES}"
PLACES7 = f"{TABLES}, {CELLS}, src AS (SELECT cell AS key, center_lat AS lat, center_lon AS lon FROM cells), {cells_sql('hex', 'src', 7)}"
PARENT5 = f"((hexagon & {~(15 << 52)}) | {5 << 52} | {(1 << 30) - 1})"

# ---- queries -----------------------------------------------------------------------------------


@query(f"WITH {PLACES7} SELECT key AS cell, lower(to_hex(hexagon)) AS hexagon, lower(to_hex({PARENT5})) AS parent FROM hex")
def hexagon_ids(spark, d):
    """Every cell's id at resolution 7 and its parent's at 5."""
    rows = hexcells.with_cells(T.cells(spark, d), 7)
    return rows.select("cell", hex_text("hexagon").alias("hexagon"), hex_text(hex_parent("hexagon", 5)).alias("parent"))


def _globe(res: int) -> str:
    return f"g{res} AS (SELECT c_custkey AS key, ((c_custkey * 37) % 17990) / 100.0::DOUBLE - 89.95::DOUBLE AS lat, ((c_custkey * 101) % 35990) / 100.0::DOUBLE - 179.95::DOUBLE AS lon FROM customer), {cells_sql(f'h{res}', f'g{res}', res)}"


def globe_points(spark, d):
    """(cell, lat, lon): the customers' keys spread over the globe."""
    key = F.col("c_custkey")
    place = [((key * 37) % 17990 / 100.0 - 89.95).alias("lat"), ((key * 101) % 35990 / 100.0 - 179.95).alias("lon")]
    return spread(T.table(spark, d, "customer").select(key.alias("cell"), *place))


@query(f"WITH {TABLES}, {_globe(1)}, {_globe(6)} SELECT key AS cell, 1 AS resolution, hexagon FROM h1 UNION ALL SELECT key, 6, hexagon FROM h6")
def hexagon_globe(spark, d):
    """Ids over the whole globe at resolutions 1 and 6, but for the base cells of the twelve pentagons, which the tests cover."""
    pentagons = [b for b, (_, _, p) in enumerate(H.HOME) if p]
    rows = globe_points(spark, d).withColumn("resolution", F.explode(F.array(F.lit(1), F.lit(6))))
    rows = rows.withColumn("hexagon", hexbatch.cells_at(F.col("lat"), F.col("lon"), F.col("resolution")))
    return rows.where(~H.base_cell_of(F.col("hexagon")).isin(pentagons)).select("cell", "resolution", "hexagon")


@query("SELECT CAST(r AS INTEGER) AS resolution, count(*) AS places, count(*) AS same FROM customer, range(16) t(r) GROUP BY 1")
def hexagon_round_trip(spark, d):
    """Places of the globe whose cell's centre lies in that same cell, by resolution: all of them."""
    rows = globe_points(spark, d).withColumn("resolution", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = rows.withColumn("hexagon", hexbatch.cells_at(F.col("lat"), F.col("lon"), F.col("resolution"))).withColumn("at", hexbatch.centres_of(F.col("hexagon")))
    same = hexbatch.cells_at(F.col("at.lat"), F.col("at.lon"), F.col("resolution")) == F.col("hexagon")
    return rows.groupBy("resolution").agg(F.count(F.lit(1)).alias("places"), F.count_if(same & F.col("at").isNotNull()).alias("same"))


@query(f"WITH {PLACES7}, ids AS (SELECT DISTINCT hexagon FROM hex), {centres_sql('mid', 'ids', 7)} SELECT key AS cell, round(lat, 7) AS lat, round(lon, 7) AS lon FROM hex JOIN mid USING (hexagon)")
def hexagon_centres(spark, d):
    rows = hexcells.with_cells(T.cells(spark, d), 7).withColumn("at", hexbatch.centres_of(F.col("hexagon")))
    return rows.select("cell", F.round("at.lat", 7).alias("lat"), F.round("at.lon", 7).alias("lon"))


HEX5 = f"{TABLES}, {CELLS}, {RISK_A}, src AS (SELECT cell AS key, center_lat AS lat, center_lon AS lon FROM cells), {cells_sql('hex', 'src', 5)}, v AS (SELECT hexagon, max(round(a, 2)) AS v FROM risk_a JOIN hex ON key = cell GROUP BY 1), {centres_sql('mid', 'v', 5)}"
_CHORD = "2 * asin(sqrt(power(sin(radians(x.lat - y.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * power(sin(radians(x.lon - y.lon) / 2), 2)))"


@query(f"WITH {HEX5}, pair AS (SELECT x.hexagon AS a, y.hexagon AS b, {_CHORD} AS far FROM mid x, mid y WHERE x.hexagon <> y.hexagon AND abs(x.lat - y.lat) < 1 AND abs(x.lon - y.lon) < 1), near AS (SELECT a, b FROM pair WHERE far < (SELECT min(far) FROM pair) * 1.4), m AS (SELECT a AS hexagon, avg(v) AS m, count(*) AS n FROM near JOIN v ON v.hexagon = b GROUP BY 1) SELECT hexagon, round(v, 2) AS risk, round(m, 6) AS around, coalesce(n, 0) AS neighbours FROM v LEFT JOIN m USING (hexagon)")
def hexagon_ring_mean(spark, d):
    """The greatest risk of each hexagon of resolution 5 and the mean of its neighbours'."""
    rows = hexcells.with_cells(T.cells(spark, d), 5).join(T.risk_a(spark, d), "cell")
    rows = rows.groupBy("hexagon").agg(F.max(F.round("a", 2)).alias("risk"))
    around = hexcells.ring_mean(rows, "risk", 1, "around")
    return rows.join(around, "hexagon").select("hexagon", "risk", F.round("around", 6).alias("around"), "neighbours")


STEP6 = hexcells.grid_step(6)
FILL = f"""{TABLES}, {CELLS}, box AS (SELECT district, min(center_lon) AS w, max(center_lon) AS e, min(center_lat) AS s, max(center_lat) AS n FROM cells GROUP BY 1),
line AS (SELECT *, unnest(generate_series(CAST(floor(s / {STEP6!r}::DOUBLE) - 2 AS BIGINT), CAST(ceil(n / {STEP6!r}::DOUBLE) + 2 AS BIGINT))) * {STEP6!r}::DOUBLE AS lat FROM box),
spot AS (SELECT district, lat, {STEP6!r}::DOUBLE / cos(radians(lat)) AS dx, unnest(generate_series(CAST(floor(w / ({STEP6!r}::DOUBLE / cos(radians(lat)))) - 2 AS BIGINT), CAST(ceil(e / ({STEP6!r}::DOUBLE / cos(radians(lat)))) + 2 AS BIGINT))) AS x FROM line),
src AS (SELECT DISTINCT {{'lat': lat, 'lon': x * dx}} AS key, lat, x * dx AS lon FROM spot), {cells_sql('hex', 'src', 6)}, ids AS (SELECT DISTINCT hexagon FROM hex), {centres_sql('mid', 'ids', 6)}"""


@query(f"WITH {FILL}, hit AS (SELECT district, hexagon FROM box, mid WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n) SELECT district, count(*) AS hexagons, min(hexagon) AS lowest, max(hexagon) AS highest, CAST(bit_xor(hexagon) AS BIGINT) AS mixed FROM hit GROUP BY 1")
def hexagon_fill(spark, d):
    """Hexagons of resolution 6 that fill each district's box, as counts and folded ids."""
    box = T.cells(spark, d).groupBy("district").agg(F.min("center_lon").alias("w"), F.max("center_lon").alias("e"), F.min("center_lat").alias("s"), F.max("center_lat").alias("n"))
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    cells = hexcells.fill(box.select("district", F.array(ring).alias("rings")), ["district"], 6)
    return cells.groupBy("district").agg(F.count(F.lit(1)).alias("hexagons"), F.min("hexagon").alias("lowest"), F.max("hexagon").alias("highest"), F.bit_xor("hexagon").alias("mixed"))
