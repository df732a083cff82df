"""Hexagon ids of whole columns: the arithmetic of `hexgrid` over Arrow batches, for tables of any size.

`hexgrid` works inside other expressions (neighbours, outlines), where each step is interpreted for each row; these functions take a
batch at a time and give the same ids and centres.
"""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from hexcast.functions import hexgrid as H

_C, _U, _V = (np.array([axis[k] for axis in H.AXES]) for k in range(3))
_SPOTS = [(f, i, j) for f in range(20) for i in range(-2, 3) for j in range(-2, 3)]
_BASE, _SIXTHS = (np.array([H.LOOKUP.get(s, (0, 0))[k] for s in _SPOTS]) for k in range(2))
#: the turn that leads out of a pentagon's missing direction, 0 elsewhere
_OUT = {(b, f): 1 if n == 0 else 5 for b, ring in H.RINGS.items() for n, (f, _, _) in enumerate(ring)}
_FIX = np.array([_OUT.get((b, f), 0) for b, (f, _, _) in zip(_BASE.tolist(), _SPOTS, strict=True)])
_HOME_FACE, _FIVE = np.array(H.HOMES), np.array([p for _, _, p in H.HOME])
_HOME_I, _HOME_J = (np.array([h[k] for h in H.HOME]) for k in range(2))
_STEP_I, _STEP_J = (np.array([s[k] for s in H.STEPS] + [0]) for k in range(2))
_TURNED = [np.arange(8)]
for _ in range(5):
    _TURNED.append(np.array(H.NEXT + [7])[_TURNED[-1]])
_TURNED = np.array(_TURNED)
#: by face, then by face and edge: the face on which a point comes to lie, and how it moves
_MOVES = np.array([(f, 0.0, 0.0, 0.0) for f in range(20)] + [(g, t * pi / 3, x, y) for f in range(20) for e in range(3) for g, t, x, y in [H.EDGES[f, e]]])
_PENTAGON = np.zeros(122, np.int64)
_PENTAGON[sorted(H.RINGS)] = range(len(H.RINGS))
_AROUND = np.array([(f, -t * pi / 3, *H.CORNERS[c]) for b in sorted(H.RINGS) for f, c, t in H.RINGS[b]])


def _shift(r: int) -> int:
    return 3 * (H.MOST - r)


def _turned(digits: np.ndarray, res: np.ndarray, sixths: np.ndarray) -> np.ndarray:
    out = np.zeros_like(digits)
    for r in range(1, int(res.max(initial=0)) + 1):
        out |= np.where(res >= r, _TURNED[sixths, digits >> _shift(r) & 7], 0) << _shift(r)
    return out


def _leading(digits: np.ndarray, res: np.ndarray) -> np.ndarray:
    out = np.zeros_like(digits)
    for r in range(1, int(res.max(initial=0)) + 1):
        out = np.where((out == 0) & (res >= r), digits >> _shift(r) & 7, out)
    return out


def _cells(lat: np.ndarray, lon: np.ndarray, res: np.ndarray) -> np.ndarray:
    """hexgrid.cell_at of known places, resolutions as int64."""
    la, lo = np.radians(lat), np.radians(lon)
    point = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
    along = lambda axes, f: point[:, 0] * axes[f, 0] + point[:, 1] * axes[f, 1] + point[:, 2] * axes[f, 2]
    face, best = np.zeros(len(lat), np.int64), np.full(len(lat), -2.0)
    for f in range(20):
        c = along(_C, f)
        face, best = np.where(c > best, f, face), np.maximum(c, best)
    u, v, scale = along(_U, face), along(_V, face), np.power(7.0, res / 2) / best / H.UNIT
    turn = np.where(res % 2 == 1, -H.TURN, 0.0)
    x, y = (u * np.cos(turn) - v * np.sin(turn)) * scale, (u * np.sin(turn) + v * np.cos(turn)) * scale
    b = y / (sqrt(3) / 2)
    a = x - b / 2
    q, r, s = np.floor(a + 0.5), np.floor(b + 0.5), np.floor(-a - b + 0.5)
    da, db, dc = np.abs(q - a), np.abs(r - b), np.abs(s + a + b)
    q, r = np.where((da > db) & (da > dc), -r - s, q), np.where((db >= da) & (db > dc), -q - s, r)
    i, j = (q + r).astype(np.int64), r.astype(np.int64)
    digits = np.zeros(len(lat), np.int64)
    for r in range(int(res.max(initial=0)), 0, -1):
        up, down = (_odd_up, _odd_down) if r % 2 else (_even_up, _even_down)
        pi_, pj = (np.floor(k / 7 + 0.5).astype(np.int64) for k in up(i, j))
        ci, cj = down(pi_, pj)
        di, dj = i - ci, j - cj
        low = np.minimum(np.minimum(di, dj), 0)
        now = res >= r
        digits |= np.where(now, (di - low) * 4 + (dj - low) * 2 - low, 0) << _shift(r)
        i, j = np.where(now, pi_, i), np.where(now, pj, j)
    spot = face * 25 + (i + 2) * 5 + j + 2
    digits = _turned(digits, res, _SIXTHS[spot])
    gap = np.flatnonzero((_FIX[spot] > 0) & (_leading(digits, res) == 1))
    digits[gap] = _turned(digits[gap], res[gap], _FIX[spot[gap]])
    return (1 << 59) | res << 52 | _BASE[spot] << 45 | digits | (np.int64(1) << 3 * (H.MOST - res)) - 1


def _odd_up(i, j):
    return i * 3 - j, i + j * 2


def _even_up(i, j):
    return i * 2 + j, j * 3 - i


def _odd_down(i, j):
    return i * 2 + j, j * 3 - i


def _even_down(i, j):
    return i * 3 - j, i + j * 2


def _is_cell(cell: np.ndarray) -> np.ndarray:
    res, base = cell >> 52 & 15, cell >> 45 & 127
    ok = (cell >> 56 == 8) & (base < 122)
    unused = (np.int64(1) << 3 * (H.MOST - res)) - 1
    ok &= cell & unused == unused
    for r in range(1, H.MOST + 1):
        ok &= (res < r) | (cell >> _shift(r) & 7 != 7)
    return ok & ~(_FIVE[np.minimum(base, 121)] & (_leading(cell, res) == 1))


def _moved(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A point of a face's plane, on the face across the edge beyond which it lies."""
    past = np.stack([x * np.cos(pi / 3 + 2 * pi / 3 * e) + y * np.sin(pi / 3 + 2 * pi / 3 * e) for e in range(3)])
    move = _MOVES[np.where(past.max(0) > 1 + 1e-12, face * 3 + past.argmax(0) + 20, face)]
    cos, sin = np.cos(move[:, 1]), np.sin(move[:, 1])
    return move[:, 0].astype(np.int64), x * cos - y * sin + move[:, 2], x * sin + y * cos + move[:, 3]


def _centres(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hexgrid.centre_of of ids that are cells."""
    res, base = cell >> 52 & 15, cell >> 45 & 127
    i, j = _HOME_I[base], _HOME_J[base]
    for r in range(1, int(res.max(initial=0)) + 1):
        ci, cj = (_odd_down if r % 2 else _even_down)(i, j)
        digit, now = cell >> _shift(r) & 7, res >= r
        i, j = np.where(now, ci + _STEP_I[digit], i), np.where(now, cj + _STEP_J[digit], j)
    size, turn = np.power(7.0, -res / 2), np.where(res % 2 == 1, H.TURN, 0.0)
    a, b = i - j / 2, j * (sqrt(3) / 2)
    x, y = (a * np.cos(turn) - b * np.sin(turn)) * size, (a * np.sin(turn) + b * np.cos(turn)) * size
    face = _HOME_FACE[base]
    five = np.flatnonzero(_FIVE[base])
    fx, fy = x[five], y[five]
    # a second edge is crossed only from large cells beside a pentagon
    face, x, y = _moved(*_moved(face, x, y))
    own = np.degrees(np.arctan2(fy, fx - 2.0)) % 360.0
    gap = (own > 210) & (own < 270)
    angle = np.where(gap & (own < 240), own + 60, np.where(gap, own - 60, own))
    ring = _AROUND[_PENTAGON[base[five]] * 5 + np.minimum(np.floor((210.0 - angle) / 60).astype(np.int64) % 6, 4)]
    far, at = np.hypot(fx - 2.0, fy), np.radians(angle) + ring[:, 1]
    face[five], x[five], y[five] = ring[:, 0], ring[:, 2] + far * np.cos(at), ring[:, 3] + far * np.sin(at)
    px, py, pz = (_C[face, k] + (x * _U[face, k] + y * _V[face, k]) * H.UNIT for k in range(3))
    return np.degrees(np.arctan2(pz, np.hypot(px, py))), np.degrees(np.arctan2(py, px))


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind, copy=False)


@F.arrow_udf(LongType())
def _cells_udf(lat: pa.Array, lon: pa.Array, res: pa.Array) -> pa.Array:
    known = lat.is_valid().to_numpy(zero_copy_only=False) & lon.is_valid().to_numpy(zero_copy_only=False) & res.is_valid().to_numpy(zero_copy_only=False)
    la, lo = _numbers(lat, "float64"), _numbers(lon, "float64")
    known &= np.isfinite(la) & np.isfinite(lo)
    out = np.zeros(len(la), np.int64)
    out[known] = _cells(la[known], lo[known], _numbers(res, "int64")[known])
    return pa.array(out, pa.int64(), mask=~known)


@F.arrow_udf(StructType().add("lat", DoubleType()).add("lon", DoubleType()))
def _centres_udf(cell: pa.Array) -> pa.Array:
    ids = _numbers(cell, "int64")
    some = _is_cell(ids)
    lat, lon = np.zeros(len(ids)), np.zeros(len(ids))
    lat[some], lon[some] = _centres(ids[some])
    return pa.StructArray.from_arrays([pa.array(lat), pa.array(lon)], ["lat", "lon"], mask=pa.array(~some))


def cells_at(lat: Column, lon: Column, resolution: int | Column) -> Column:
    """The id of the cell that holds a place in degrees; null for places that are null or not finite."""
    res = F.lit(resolution) if isinstance(resolution, int) else resolution
    return _cells_udf(lat.cast("double"), lon.cast("double"), res.cast("int"))


def centres_of(cell: Column) -> Column:
    """(lat, lon) in degrees of a cell's centre; null for a null id or one that is no cell."""
    return _centres_udf(cell.cast("long"))
