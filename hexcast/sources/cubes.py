"""A Python data source for gridded daily cubes that skips days and rows of the grid before it reads.

format("grid_cube") reads flat little-endian float32 files of day x latitude x longitude. A file's days are cut into partitions of
`days` days, so one file is many tasks, and each task seeks to the bytes of its own days and latitudes. Filters on date,
lat and lon are pushed: days without a match get no partition, latitudes without one are not read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "date date, lat double, lon double, value double"


@dataclass
class Slab(InputPartition):
    """Days first to last (numbers within the file) of the latitudes low to high."""

    path: str
    start: date
    first: int
    last: int
    low: int
    high: int


class GridCubeSource(DataSource):
    """Options: files (JSON list of {path, start, days}; start is the first day, ISO), rows, cols, west, south, step, days (a
    partition's), missing (the value that stands for none; such cells are null).

    Paths are read through pyarrow's file systems, so they may lie in a store that all executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "grid_cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.rows, self.cols = int(options["rows"]), int(options["cols"])
        self.west, self.south, self.step = (float(options[k]) for k in ("west", "south", "step"))
        self.days = int(options.get("days", 31))
        self.missing = float(options["missing"]) if "missing" in options else None
        self.tests: dict[str, list] = {"date": [], "lat": [], "lon": []}

    def pushFilters(self, filters: list[Filter]):
        """Comparisons with a constant are taken over whole; the rest is left to Spark."""
        kinds = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.tests and type(f) in kinds:
                self.tests[name].append((kinds[type(f)], f.value))
            elif name in self.tests and isinstance(f, In):
                self.tests[name].append((np.isin, list(f.value)))
            else:
                yield f

    def _kept(self, name: str, values: np.ndarray) -> np.ndarray:
        ok = np.ones(len(values), bool)
        for test, bound in self.tests[name]:
            ok &= test(values, np.array(bound, "datetime64[D]") if name == "date" else bound)
        return ok

    def _latitudes(self) -> np.ndarray:
        return self.south + np.arange(self.rows) * self.step

    def partitions(self):
        lat = np.flatnonzero(self._kept("lat", self._latitudes()))
        out = []
        for f in self.files if len(lat) else []:
            start = date.fromisoformat(f["start"])
            days = np.flatnonzero(self._kept("date", np.datetime64(start) + np.arange(f["days"])))
            for first in range(0, f["days"], self.days):
                here = days[(days >= first) & (days < first + self.days)]
                if len(here):
                    out.append(Slab(f["path"], start, int(here[0]), int(here[-1]), int(lat[0]), int(lat[-1])))
        return out or [Slab("", date(1970, 1, 1), 0, -1, 0, -1)]  # Spark asks for one partition

    def read(self, slab: Slab):
        from pyarrow import fs

        if slab.last < slab.first:
            return
        store, path = fs.FileSystem.from_uri(slab.path)
        lat, lon = self._latitudes()[slab.low : slab.high + 1], self.west + np.arange(self.cols) * self.step
        on_lat, on_lon = self._kept("lat", lat), self._kept("lon", lon)
        with store.open_input_file(path) as file:
            for day in range(slab.first, slab.last + 1):
                at = slab.start + timedelta(days=day)
                if not self._kept("date", np.array([at], "datetime64[D]"))[0]:
                    continue
                file.seek(4 * self.cols * (day * self.rows + slab.low))
                band = np.frombuffer(file.read(4 * self.cols * len(lat)), "<f4").reshape(len(lat), self.cols)[on_lat][:, on_lon]
                value = band.ravel().astype(float)
                gone = np.isnan(value) if self.missing is None else np.isnan(value) | (value == self.missing)
                columns = [
                    pa.array([at] * len(value), pa.date32()), pa.array(np.repeat(lat[on_lat], int(on_lon.sum()))),
                    pa.array(np.tile(lon[on_lon], int(on_lat.sum()))), pa.array(value, mask=gone),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["date", "lat", "lon", "value"])


def read_cubes(spark: SparkSession, files: list[dict], rows: int, cols: int, west: float, south: float, step: float, days: int = 31, missing: float | None = None) -> DataFrame:
    """(date, lat, lon, value) of cube files; see GridCubeSource. No files give no rows."""
    spark.dataSource.register(GridCubeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"files": json.dumps(files), "rows": rows, "cols": cols, "west": west, "south": south, "step": step, "days": days}
    if missing is not None:
        options["missing"] = missing
    # a filter in every plan: without one Spark would take the reader of an earlier query on the same frame, its filters included
    return spark.read.format("grid_cube").options(**options).load().where(F.col("date").isNotNull())


def write_cubes(rows: DataFrame, folder: str, shape: tuple[int, int], days: int, missing: float) -> list[dict]:
    """Write (date, row, col, value) as cube files of `days` days each and list them for read_cubes().

    Days are counted from 1970-01-01; a file is one group of days, written by one task that holds days x rows x cols values, and
    spans without a value get no file. Cells without a value hold `missing`. A task that is run again writes a file of another
    name; only the names of finished tasks are listed.
    """
    high, wide = shape

    def write(block: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        first = int(block["block"].iloc[0]) * days
        cube = np.full((days, high, wide), missing, "<f4")
        known = block[block["value"].notna()]
        cube[known["day"].to_numpy() - first, known["row"].to_numpy(), known["col"].to_numpy()] = known["value"]
        path = f"{folder}/cube-{first}-{uuid.uuid4().hex}.f4"
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(cube.tobytes())
        return pd.DataFrame({"path": [path], "start": [(date(1970, 1, 1) + timedelta(days=first)).isoformat()], "days": [days]})

    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    cells = rows.select(day.alias("day"), F.floor(day / days).cast("int").alias("block"), F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double"))
    made = cells.groupBy("block").applyInPandas(write, "path string, start string, days int").collect()  # one row for each file
    return [r.asDict() for r in sorted(made, key=lambda r: r["start"])]
