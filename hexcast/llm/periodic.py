"""Operator 12, periodic run detection: bit-parallel comparison of a text's words with themselves at a lag.

A text's words become numbers, and bit b of all numbers one big integer, a plane. XOR of a plane with itself shifted by
a lag marks the words that differ there in that bit; OR over the planes marks all that differ. Stretches of
zeros at least LEAST_EXPONENT - 1 lags long are left over by shift-doubling AND.

Only lags that can hold a run are compared: in a run of smallest period q, each window of q to 2q - 1 words last
occurred exactly q words before (a smaller distance would be a smaller period), so for each window length w, a power of two,
the lags in (w/2, w] are those at which enough windows repeat. Windows are numbered by prefix doubling, without hashes.
This is a necessary condition, so no run is lost, and a text of n words costs about n log(n) and not n^2.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import lean, small_batches

LEAST_EXPONENT = 4
LEAST_WORDS = 6
SCHEMA = "runs array<struct<start: long, length: long, period: long>>, top struct<start: long, length: long, period: long>, collapsed string"


def possible_lags(ids: np.ndarray) -> list[int]:
    """Every lag that is the smallest period of a run, and perhaps others, ascending."""
    n, out = len(ids), []
    number, w = ids, 1
    while w // 2 + 1 <= n // LEAST_EXPONENT:
        order = np.argsort(number, kind="stable")
        same = number[order[1:]] == number[order[:-1]]
        if not same.any():
            break
        back = np.diff(order)[same]
        times = np.bincount(back[back <= w], minlength=w + 1)
        q = np.arange(w // 2 + 1, w + 1)
        least = np.maximum(LEAST_WORDS, LEAST_EXPONENT * q) - q - w + 1
        out += q[times[q] >= least].tolist()
        if len(number) <= w:
            break
        pair = number[:-w] * (int(number.max()) + 1) + number[w:]
        number = np.unique(pair, return_inverse=True)[1]
        w *= 2
    return out


def planes(ids: np.ndarray) -> list[int]:
    """Plane b holds bit b of every number, the first word in the lowest place."""
    bits = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def periodic_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs by start, then period.

    A run's period is its smallest, its length at least LEAST_EXPONENT periods and LEAST_WORDS words.
    """
    n, found = len(ids), {}
    lags = possible_lags(ids)
    held = planes(ids) if lags else []
    for q in lags:
        differ = 0
        for p in held:
            differ |= p ^ (p >> q)
        rest = ~differ & ((1 << (n - q)) - 1)
        need, have = max(LEAST_WORDS, LEAST_EXPONENT * q) - q, 1
        while have < need and rest:
            step = min(have, need - have)
            rest &= rest >> step
            have += step
        if rest:
            bits = np.unpackbits(np.frombuffer(rest.to_bytes((n >> 3) + 1, "little"), np.uint8), bitorder="little")
            edge = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
            for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                found.setdefault((low, high - low + need - 1 + q), q)  # a multiple of the period gives the same stretch
    return sorted((start, length, q) for (start, length), q in found.items())


def numbers(words: list) -> np.ndarray:
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def without_runs(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words, each run cut to its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, top, collapsed) of every row: the periodic runs of a text and the text without their repeats.

    Words are split at ASCII white space. runs ascend by start, then period; top is the run of greatest exact length by
    period (ties: smallest start, then period), null without runs; collapsed joins by a blank the words that no run
    contains after its first period. Null, empty and blank texts have no runs and collapse to an empty text. Whole texts of any
    length are searched. Rows with equal or null keys each give their row; keys of any type pass unchanged.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches):
        for batch in batches:
            every, tops, collapsed = [], [], []
            for t in batch.column("text"):
                words = t.as_py().encode().split()  # bytes split at exactly the six ASCII white spaces
                runs = periodic_runs(numbers(words))
                top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
                every.append(named)
                tops.append(named[runs.index(top)] if top else None)
                collapsed.append(b" ".join(without_runs(words, runs)).decode())
            columns = [batch.column("key"), pa.array(every, pa.list_(run)), pa.array(tops, run), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "runs", "top", "collapsed"])

    return source.mapInArrow(lean(search), f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
