"""Hexagon ids of 64 bits on an icosahedron, as column expressions: place to cell, cell to centre, outline and neighbours.

Faces are gnomonic planes whose hexagons each hold seven of the next resolution. An id is a base cell and a digit for each
resolution. All tables below follow from the faces' centres, the azimuths of their first axes, and the home face of each base
cell; the unfolding of faces across edges and around the twelve pentagons is worked out here by geometry.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import asin, atan2, cos, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: latitude and longitude of each face's centre, and the azimuth of its first axis, in radians
FACES = [
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
]
#: fixed values: the face in whose axes a base cell's digits are counted, for base cells 0 to 121
HOMES = [
    1, 2, 1, 2, 0, 1, 1, 2, 0, 2, 1, 1, 3, 3, 11, 4, 0, 6, 0, 2, 7, 2, 0, 6, 10, 6, 3, 11, 4, 3, 0,
    4, 5, 0, 7, 11, 7, 10, 12, 6, 7, 4, 3, 3, 4, 6, 11, 8, 5, 14, 5, 12, 10, 4, 12, 7, 11, 10, 13, 10, 11,
    9, 8, 6, 8, 9, 14, 5, 16, 8, 5, 12, 7, 12, 10, 9, 13, 16, 15, 15, 16, 14, 13, 5, 8, 14, 9, 14, 17, 12, 16,
    17, 15, 16, 9, 15, 13, 8, 13, 17, 19, 14, 19, 17, 13, 17, 16, 9, 15, 15, 18, 18, 19, 17, 19, 18, 18, 19, 19, 18, 19, 18,
]
UNIT = 0.38196601125010500003  # of the base cells' lattice, on the gnomonic plane
TURN = asin(sqrt(3 / 28))  # odd resolutions are turned by this
MOST = 15
#: what a digit adds to (i, j), axes at 0 and 120 degrees
STEPS = [(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)]
#: the digit 60 degrees counter-clockwise of each
NEXT = [0, 5, 3, 1, 6, 4, 2]
CORNERS = [(2.0, 0.0), (-1.0, sqrt(3)), (-1.0, -sqrt(3))]  # of a face, on its plane


def _axes(lat: float, lon: float, azimuth: float) -> tuple:
    """(centre, first axis, axis 90 degrees counter-clockwise) of a face's plane."""
    centre = (cos(lat) * cos(lon), cos(lat) * sin(lon), sin(lat))
    north = (-sin(lat) * cos(lon), -sin(lat) * sin(lon), cos(lat))
    east = (-sin(lon), cos(lon), 0.0)
    along = lambda a: tuple(cos(a) * n + sin(a) * e for n, e in zip(north, east, strict=True))
    return centre, along(azimuth), along(azimuth - pi / 2)


AXES = [_axes(*f) for f in FACES]


def _on_sphere(face: int, x: float, y: float) -> tuple[float, float, float]:
    c, u, v = AXES[face]
    p = [a + UNIT * (x * b + y * d) for a, b, d in zip(c, u, v, strict=True)]
    size = sqrt(sum(a * a for a in p))
    return tuple(a / size for a in p)


def _place(p: tuple) -> tuple:
    """A point's name, the same from every face."""
    return tuple(round(a, 6) + 0.0 for a in p)


def _xy(i: int, j: int) -> tuple[float, float]:
    return i - j / 2, j * sqrt(3) / 2


def _turned(x: float, y: float, sixths: int) -> tuple[float, float]:
    a = sixths * pi / 3
    return x * cos(a) - y * sin(a), x * sin(a) + y * cos(a)


def _edges() -> dict[tuple[int, int], tuple[int, int, float, float]]:
    """By (face, edge): the face across, and how its plane's axes follow: sixths of a turn, then a shift.

    Edge e runs from corner e to the next.
    """
    ends = {f: [_place(_on_sphere(f, *c)) for c in CORNERS] for f in range(20)}
    out = {}
    for f in range(20):
        for e in range(3):
            a, b = ends[f][e], ends[f][(e + 1) % 3]
            g = next(g for g in range(20) if g != f and a in ends[g] and b in ends[g])
            pa, pb, qa, qb = CORNERS[e], CORNERS[(e + 1) % 3], CORNERS[ends[g].index(a)], CORNERS[ends[g].index(b)]
            turn = round((atan2(qb[1] - qa[1], qb[0] - qa[0]) - atan2(pb[1] - pa[1], pb[0] - pa[0])) / (pi / 3)) % 6
            x, y = _turned(*pa, turn)
            out[f, e] = (g, turn, qa[0] - x, qa[1] - y)
    return out


EDGES = _edges()


def _beyond(x: float, y: float) -> int | None:
    """The edge of a face's triangle beyond which a point lies."""
    past = [x * cos(pi / 3 + 2 * pi / 3 * e) + y * sin(pi / 3 + 2 * pi / 3 * e) for e in range(3)]
    return past.index(max(past)) if max(past) > 1 + 1e-9 else None


def _base_cells() -> tuple[list, dict, dict]:
    """What the faces say of the 122 base cells, which are numbered from north to south.

    [(i, j, pentagon)] by base cell, on its home face; {(face, i, j): (base cell, sixths of a turn to the home axes)}; and
    {pentagon: [(face, its corner, the same sixths)]}, clockwise from the home face.
    """
    inside = sorted({(i, j) for i in range(-2, 3) for j in range(-2, 3) if _beyond(*_xy(i, j)) is None})
    where: dict[tuple, list] = {}
    for f in range(20):
        for i, j in inside:
            where.setdefault(_place(_on_sphere(f, *_xy(i, j))), []).append((f, i, j))
    cells = sorted(where, key=lambda p: -asin(p[2]))
    home, number = [], {}
    for b, p in enumerate(cells):
        at = {f: (i, j) for f, i, j in where[p]}
        i, j = at[HOMES[b]]
        home.append((i, j, len(at) == 5))
        number[p] = b

    def sixths(f: int, i: int, j: int, b: int) -> int:
        """How far digits counted on face f turn to be counted on the base cell's home face."""
        h = HOMES[b]
        if f == h:
            return 0
        if home[b][2]:  # around a pentagon: sectors follow clockwise from the home face, whose direction K is left out
            spin = _around(b)
            return (-spin[f] - 2 * _corner(f, cells[b])) % 6
        return next(turn for e in range(3) for g, turn, _, _ in [EDGES[f, e]] if g == h and _beyond(*_xy(i, j)) is None)

    def _corner(f: int, p: tuple) -> int:
        return [_place(_on_sphere(f, *c)) for c in CORNERS].index(p)

    def _around(b: int) -> dict[int, int]:
        """Faces around a pentagon by their number clockwise from the home face."""
        out, f = {}, HOMES[b]
        for n in range(5):
            out[f] = n
            k = _corner(f, cells[b])  # clockwise is across the edge that begins at the corner
            f = EDGES[f, k][0] if n == 0 else next(EDGES[f, e][0] for e in (k, (k + 2) % 3) if EDGES[f, e][0] not in out or n == 4)
        return out

    lookup = {}
    for f in range(20):
        for i in range(-2, 3):
            for j in range(-2, 3):
                x, y = _xy(i, j)
                at, g, turn = (x, y), f, 0
                if (e := _beyond(x, y)) is not None:
                    g, turn, dx, dy = EDGES[f, e]
                    rx, ry = _turned(x, y, turn)
                    at = (rx + dx, ry + dy)
                if (b := number.get(_place(_on_sphere(g, *at)))) is not None and _beyond(*at) is None:
                    gj = round(at[1] / (sqrt(3) / 2))
                    lookup[f, i, j] = (b, (turn + sixths(g, round(at[0] + gj / 2), gj, b)) % 6)
    rings = {}
    for b in range(122):
        if home[b][2]:
            corner = {f: _corner(f, cells[b]) for f in _around(b)}
            rings[b] = [(f, corner[f], (-n - 2 * corner[f]) % 6) for f, n in _around(b).items()]
    return home, lookup, rings


HOME, LOOKUP, RINGS = _base_cells()

# ---- the tables as columns ---------------------------------------------------------------------


def _table(rows: list[dict]) -> Column:
    """An array of structs that Spark reads once, when it folds constants."""
    kinds = {bool: "boolean", int: "int", float: "double"}
    fields = ", ".join(f"{k}: {kinds[type(v)]}" for k, v in rows[0].items())
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def _faces() -> Column:
    names = [a + b for a in "cuv" for b in "xyz"]
    return _table([{"face": f} | dict(zip(names, [float(x) for axis in AXES[f] for x in axis], strict=True)) for f in range(20)])


def _lookup() -> Column:
    """By face, i and j: base cell, turn, and the turn that leads out of a pentagon's missing direction."""
    fix = {(b, f): 1 if n == 0 else 5 for b, ring in RINGS.items() for n, (f, _, _) in enumerate(ring)}
    spots = [(f, i, j) for f in range(20) for i in range(-2, 3) for j in range(-2, 3)]
    each = [(*LOOKUP.get(s, (0, 0)), s[0]) for s in spots]
    return _table([{"base": b, "turn": t, "fix": fix.get((b, f), 0)} for b, t, f in each])


def _homes() -> Column:
    return _table([{"face": HOMES[b], "i": i, "j": j, "pentagon": p} for b, (i, j, p) in enumerate(HOME)])


def _edge_table() -> Column:
    rows = [{"face": f, "turn": 0.0, "dx": 0.0, "dy": 0.0} for f in range(20)]
    rows += [{"face": g, "turn": t * pi / 3, "dx": x, "dy": y} for f in range(20) for e in range(3) for g, t, x, y in [EDGES[f, e]]]
    return _table(rows)


def _ring_table() -> Column:
    rows = [ring for b in range(122) for ring in RINGS.get(b, [])]
    return _table([{"face": f, "turn": -t * pi / 3, "x": CORNERS[c][0], "y": CORNERS[c][1]} for f, c, t in rows])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _steps(resolution: Column) -> Column:
    return F.when(resolution > 0, F.sequence(F.lit(1), resolution)).otherwise(F.array().cast("array<int>"))


def _shift(value: Column, level: Column) -> Column:
    """value in the place of a level's digit."""
    return F.call_function("shiftleft", value.cast("bigint"), (F.lit(3 * MOST) - level * 3).cast("int"))


def _digit(digits: Column, level: Column) -> Column:
    return F.call_function("shiftright", digits, (F.lit(3 * MOST) - level * 3).cast("int")).bitwiseAND(F.lit(7)).cast("int")


def _near(x: Column) -> Column:
    return F.floor(x + 0.5)


def _turned_digits(digits: Column, resolution: Column, sixths: Column) -> Column:
    table, row = [], list(range(7))
    for _ in range(6):
        table += row
        row = [NEXT[d] for d in row]
    listed = F.from_json(F.lit(json.dumps(table)), "array<int>")
    one = lambda acc, r: acc.bitwiseOR(_shift(F.get(listed, sixths * 7 + _digit(digits, r)), r))
    return F.aggregate(_steps(resolution), F.lit(0).cast("bigint"), one)


def _leading(digits: Column, resolution: Column) -> Column:
    return F.aggregate(_steps(resolution), F.lit(0), lambda acc, r: F.when(acc != 0, acc).otherwise(_digit(digits, r)))


def resolution_of(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell_of(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(F.lit(127)).cast("int")


def is_cell(cell: Column) -> Column:
    """Whether an id is a cell: its mode, base cell, digits up to its resolution, and the direction that pentagons lack."""
    return _let(cell, _is_cell)


def _is_cell(cell: Column) -> Column:
    res = resolution_of(cell)
    used = F.aggregate(_steps(res), F.lit(True), lambda acc, r: acc & (_digit(cell, r) < 7))
    unused = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(3 * MOST) - res * 3).cast("int")) - 1
    lacks = F.get(_homes(), base_cell_of(cell))["pentagon"] & (_leading(cell, res) == 1)
    whole = (F.shiftright(cell, 56) == 8) & (base_cell_of(cell) < 122) & (cell.bitwiseAND(unused) == unused)
    return F.coalesce(whole & used & ~lacks, F.lit(False))


def is_pentagon(cell: Column) -> Column:
    return _let(cell, _is_pentagon)


def _is_pentagon(cell: Column) -> Column:
    return F.get(_homes(), base_cell_of(cell))["pentagon"] & (_leading(cell, resolution_of(cell)) == 0)


def cell_at(lat: Column, lon: Column, resolution: int | Column) -> Column:
    """The id of the cell that holds a place in degrees; null for null places.

    The nearest face's plane gives lattice coordinates; going up a resolution at a time leaves a digit each, and the
    base cell's home face says how far the digits turn.
    """
    res = F.lit(resolution) if isinstance(resolution, int) else resolution.cast("int")
    la, lo = F.radians(lat), F.radians(lon)
    point = F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))

    def on_face(p: Column) -> Column:
        dot = lambda f, a: p["x"] * f[a + "x"] + p["y"] * f[a + "y"] + p["z"] * f[a + "z"]
        return F.array_max(F.transform(_faces(), lambda f: F.struct(dot(f, "c").alias("c"), (-f["face"]).alias("face"), dot(f, "u").alias("u"), dot(f, "v").alias("v"))))

    def plane(f: Column) -> Column:
        scale = F.pow(F.lit(7.0), res / 2) / f["c"] / UNIT
        turn = F.when(res % 2 == 1, -TURN).otherwise(0.0)
        x = (f["u"] * F.cos(turn) - f["v"] * F.sin(turn)) * scale
        y = (f["u"] * F.sin(turn) + f["v"] * F.cos(turn)) * scale
        b = y / (sqrt(3) / 2)
        return F.struct((-f["face"]).alias("face"), (x - b / 2).alias("q"), b.alias("r"))

    def lattice(p: Column) -> Column:
        q, r, s = _near(p["q"]), _near(p["r"]), _near(-p["q"] - p["r"])
        a, b, c = F.abs(q - p["q"]), F.abs(r - p["r"]), F.abs(s + p["q"] + p["r"])
        q, r = F.when((a > b) & (a > c), -r - s).otherwise(q), F.when((b >= a) & (b > c), -q - s).otherwise(r)
        return F.struct(p["face"].alias("face"), (q + r).alias("i"), r.alias("j"))

    def up(acc: Column, r: Column) -> Column:
        i, j, odd = acc["i"], acc["j"], r % 2 == 1
        pick = lambda a, b: F.when(odd, a).otherwise(b)
        parent = F.struct(_near(pick(i * 3 - j, i * 2 + j) / 7).alias("i"), _near(pick(i + j * 2, j * 3 - i) / 7).alias("j"))

        def step(p: Column) -> Column:
            di = i - pick(p["i"] * 2 + p["j"], p["i"] * 3 - p["j"])
            dj = j - pick(p["j"] * 3 - p["i"], p["i"] + p["j"] * 2)
            low = F.least(di, dj, F.lit(0))
            digit = (di - low) * 4 + (dj - low) * 2 - low
            return F.struct(p["i"].alias("i"), p["j"].alias("j"), acc["digits"].bitwiseOR(_shift(digit, r)).alias("digits"))

        return _let(parent, step)

    def index(at: Column) -> Column:
        start = F.struct(at["i"].alias("i"), at["j"].alias("j"), F.lit(0).cast("bigint").alias("digits"))
        climbed = F.aggregate(F.reverse(_steps(res)), start, up)

        def turned(c: Column) -> Column:
            spot = _lookup()[(at["face"] * 25 + (c["i"] + 2) * 5 + c["j"] + 2).cast("int")]
            return _let(spot, lambda b: _let(_turned_digits(c["digits"], res, b["turn"]), lambda d: whole(b, d)))

        return _let(climbed, turned)

    def whole(b: Column, digits: Column) -> Column:
        out = F.when((b["fix"] > 0) & (_leading(digits, res) == 1), _turned_digits(digits, res, b["fix"])).otherwise(digits)
        unused = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(3 * MOST) - res * 3).cast("int")) - 1
        top = F.lit(1 << 59).bitwiseOR(F.call_function("shiftleft", res.cast("bigint"), F.lit(52))).bitwiseOR(F.call_function("shiftleft", b["base"].cast("bigint"), F.lit(45)))
        return top.bitwiseOR(out).bitwiseOR(unused)

    found = _let(point, lambda p: _let(on_face(p), lambda f: _let(plane(f), lambda q: _let(lattice(q), index))))
    return F.when(lat.isNotNull() & lon.isNotNull(), found)


def _on_plane(cell: Column) -> Column:
    """(base, x, y, resolution) of a cell's centre on its base cell's home plane, in base cells' steps."""
    res = resolution_of(cell)
    step = _table([{"i": i, "j": j} for i, j in STEPS])

    def down(acc: Column, r: Column) -> Column:
        i, j, odd, by = acc["i"], acc["j"], r % 2 == 1, F.get(step, _digit(cell, r))
        pick = lambda a, b: F.when(odd, a).otherwise(b)
        return F.struct((pick(i * 2 + j, i * 3 - j) + by["i"]).alias("i"), (pick(j * 3 - i, i + j * 2) + by["j"]).alias("j"))

    def flat(c: Column) -> Column:
        size = F.pow(F.lit(7.0), -res / 2)
        turn = F.when(res % 2 == 1, TURN).otherwise(0.0)
        x, y = c["i"] - c["j"] / 2, c["j"] * (sqrt(3) / 2)
        return F.struct(base_cell_of(cell).alias("base"), ((x * F.cos(turn) - y * F.sin(turn)) * size).alias("x"), ((x * F.sin(turn) + y * F.cos(turn)) * size).alias("y"), res.alias("resolution"))

    home = lambda h: F.struct(h["i"].cast("bigint").alias("i"), h["j"].cast("bigint").alias("j"))
    return _let(F.aggregate(_steps(res), _let(F.get(_homes(), base_cell_of(cell)), home), down), flat)


def _unfolded(base: Column, x: Column, y: Column, ox: Column | None = None, oy: Column | None = None) -> Column:
    """(lat, lon) in degrees of a point on a base cell's home plane, which may lie on a face around it.

    (ox, oy) is where the point was reached from: around a pentagon it says on which side of the missing sector, from 210
    to 270 degrees, a point in it belongs.
    """
    ox, oy = (x, y) if ox is None else (ox, oy)

    def across(at: Column) -> Column:
        x, y = at["x"], at["y"]
        past = [x * cos(pi / 3 + 2 * pi / 3 * e) + y * sin(pi / 3 + 2 * pi / 3 * e) for e in range(3)]
        far = F.greatest(*past)
        edge = F.when(past[0] == far, 0).when(past[1] == far, 1).otherwise(2)
        row = F.when(far > 1 + 1e-12, at["face"] * 3 + edge + 20).otherwise(at["face"])
        moved = lambda e: F.struct(e["face"].alias("face"), (x * F.cos(e["turn"]) - y * F.sin(e["turn"]) + e["dx"]).alias("x"), (x * F.sin(e["turn"]) + y * F.cos(e["turn"]) + e["dy"]).alias("y"))
        return _let(_edge_table()[row.cast("int")], moved)

    def around(_: Column) -> Column:
        full = lambda a, b: F.pmod(F.degrees(F.atan2(b, a - 2.0)), F.lit(360.0))
        own = full(x, y)
        source = F.when(F.hypot(ox - 2.0, oy) < 1e-9, own).otherwise(full(ox, oy))
        gap = (own > 210) & (own < 270)
        angle = F.when(gap & (source > 90) & (source < 240), own + 60).when(gap, own - 60).otherwise(own)
        pentagons = F.array(*[F.lit(b) for b in sorted(RINGS)])

        def placed(a: Column) -> Column:
            n = F.least(F.pmod(F.floor((F.lit(210.0) - a) / 60), F.lit(6)), F.lit(4))
            row = _ring_table()[((F.array_position(pentagons, base) - 1) * 5 + n).cast("int")]
            far = F.hypot(x - 2.0, y)
            moved = lambda e: F.struct(e["face"].alias("face"), (e["x"] + far * F.cos(F.radians(a) + e["turn"])).alias("x"), (e["y"] + far * F.sin(F.radians(a) + e["turn"])).alias("y"))
            return _let(row, moved)

        return _let(angle, placed)

    def place(p: Column) -> Column:
        def on(f: Column) -> Column:
            part = lambda a: f["c" + a] + (p["x"] * f["u" + a] + p["y"] * f["v" + a]) * UNIT
            lon = F.degrees(F.atan2(part("y"), part("x")))
            return F.struct(F.degrees(F.atan2(part("z"), F.hypot(part("x"), part("y")))).alias("lat"), lon.alias("lon"))

        return _let(_faces()[p["face"]], on)

    def home(h: Column) -> Column:
        at = F.struct(h["face"].alias("face"), x.alias("x"), y.alias("y"))
        # a second edge is crossed only from large cells beside a pentagon
        return _let(F.when(h["pentagon"], around(h)).otherwise(_let(_let(at, across), across)), place)

    return _let(F.get(_homes(), base), home)


def centre_of(cell: Column) -> Column:
    """(lat, lon) in degrees of a cell's centre; null for a null id or one that is no cell."""
    return _let(cell, lambda c: F.when(_is_cell(c), _let(_on_plane(c), lambda p: _unfolded(p["base"], p["x"], p["y"]))))


def _at_angle(p: Column, angle: Column, far: float) -> Column:
    """(lat, lon) of the point at an angle from a cell's centre, `far` steps of its resolution away."""
    size = F.pow(F.lit(7.0), -p["resolution"] / 2) * far
    a = F.radians(angle) + F.when(p["resolution"] % 2 == 1, TURN).otherwise(0.0)
    return _let(F.struct((p["x"] + size * F.cos(a)).alias("x"), (p["y"] + size * F.sin(a)).alias("y")), lambda q: _unfolded(p["base"], q["x"], q["y"], p["x"], p["y"]))


def outline_of(cell: Column) -> Column:
    """The corners (lat, lon) of a cell counter-clockwise, five for a pentagon, without the points where face edges cross its sides."""
    listed = lambda *degrees: F.array(*map(F.lit, degrees))

    def corners(c: Column) -> Column:
        angles = F.when(_is_pentagon(c), listed(30.0, 90.0, 150.0, 210.0, 330.0)).otherwise(listed(30.0, 90.0, 150.0, 210.0, 270.0, 330.0))
        return F.when(_is_cell(c), _let(_on_plane(c), lambda p: F.transform(angles, lambda a: _at_angle(p, a, 1 / sqrt(3)))))

    return _let(cell, corners)


def neighbours_of(cell: Column) -> Column:
    """The ids of the six cells around a cell, five around a pentagon."""

    def around(c: Column) -> Column:
        def one(p: Column) -> Column:
            angles = F.array(*[F.lit(60.0 * k) for k in range(6)])
            ids = F.transform(angles, lambda a: _let(_at_angle(p, a, 1.0), lambda q: cell_at(q["lat"], q["lon"], p["resolution"])))
            return F.array_distinct(F.filter(ids, lambda near: near != c))

        return F.when(_is_cell(c), _let(_on_plane(c), one))

    return _let(cell, around)
