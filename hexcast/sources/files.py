"""Readers and writers of the panel's file formats, all through Spark's own sources."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "h3_index string, center_lat double, center_lon double, district string, state string"
WEATHER = "State string, District string, Year int, Week int, Rainfall_mm double, Tmax_C double, Tmin_C double"
POPULATION = "State string, District string, Year int, Population double"
INTERVALS = "prediction double, actual double, lower_90 double, upper_90 double, lower_95 double, upper_95 double"
_DAILY = "struct<temperature_2m_max: array<double>, temperature_2m_min: array<double>, precipitation_sum: array<double>>"
WEATHER_DOCS = f"h3_index string, daily {_DAILY}"
_PIXELS = "path string, row int, col int, lon double, lat double, value double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a declared schema; only used columns are parsed."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_weather_docs(spark: SparkSession, path: str) -> DataFrame:
    """Nested weather documents: JSON arrays of objects, plain or gzip."""
    return spark.read.schema(WEATHER_DOCS).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def write_weather_docs(docs: DataFrame, path: str, size: int = 2000) -> None:
    """Write (h3_index, daily) as gzip JSON files of arrays of about `size` documents, dealt by the hash of their id."""
    arrays = max(1, -(-docs.count() // size))
    dealt = docs.groupBy(F.pmod(F.xxhash64("h3_index"), F.lit(arrays)).alias("array"))
    listed = dealt.agg(F.to_json(F.sort_array(F.collect_list(F.struct("h3_index", "daily")))).alias("value"))
    listed.repartition("array").write.partitionBy("array").option("compression", "gzip").text(path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(value): the elements of JSON arrays of strings, such as checkpoint lists."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def read_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON polygons: the named properties and rings (array of arrays of lon/lat structs).

    A multipolygon's rings are those of all its parts, to be read by the even-odd rule.
    """
    text = spark.read.text(path, wholetext=True)
    shape = f"struct<features: array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>>"
    f = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.properties.*", F.col("f.geometry").alias("g"))
    single = F.from_json("g.coordinates", "array<array<array<double>>>")
    several = F.flatten(F.from_json("g.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("g.type") == "MultiPolygon", several).otherwise(single)
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return f.withColumn("rings", points).drop("g")


def _tiff_pixels(data: bytes) -> tuple[np.ndarray, float, float, float, float]:
    """(values, west, north, width, height of a pixel) of an uncompressed GeoTIFF; nodata becomes 0."""
    end = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", data[4:8])
    (n,) = struct.unpack(end + "H", data[at : at + 2])
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
    tags = {}
    for k in range(n):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(end + "HHI", entry[:8])
        if kind not in kinds:
            continue
        form = f"{end}{count}{kinds[kind]}"
        size = struct.calcsize(form)
        raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(end + "I", entry[8:])[0]) : p + size]
        tags[tag] = struct.unpack(form, raw)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("only uncompressed rasters are read")
    wide, high, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    letter = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    body = b"".join(data[o : o + c] for o, c in zip(tags[273], tags[279], strict=True))
    values = np.frombuffer(body, f"{end}{letter}{bits // 8}").reshape(high, wide).astype(float)
    if 42113 in tags:
        values = np.where(values == float(tags[42113][0].split(b"\0")[0]), 0.0, values)
    scale, tie = tags[33550], tags[33922]
    return values, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """One row for each pixel of GeoTIFF files: row, col, centre and value. A file is one task's unit."""

    def explode(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                values, west, north, dx, dy = _tiff_pixels(bytes(content))
                row, col = np.indices(values.shape)
                yield pd.DataFrame({
                    "path": name, "row": row.ravel().astype(np.int32), "col": col.ravel().astype(np.int32),
                    "lon": west + (col.ravel() + 0.5) * dx, "lat": north - (row.ravel() + 0.5) * dy, "value": values.ravel(),
                })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(explode, _PIXELS)


def read_grid_cube(spark: SparkSession, path: str, rows: int, cols: int, west: float, south: float, step: float, start_of) -> DataFrame:
    """(date, lon, lat, value) of flat float32 day x lat x lon files; start_of(path) gives a file's first day."""

    def explode(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                cube = np.frombuffer(bytes(content), "<f4").reshape(-1, rows, cols)
                first = pd.Timestamp(start_of(name))
                r, c = np.indices((rows, cols))
                for day, values in enumerate(cube):
                    yield pd.DataFrame({
                        "date": (first + pd.Timedelta(days=day)).date(), "lon": west + c.ravel() * step, "lat": south + r.ravel() * step, "value": values.ravel().astype(float),
                    })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(explode, "date date, lon double, lat double, value double")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).option("compression", "zstd").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def version(year: int, week: int) -> str:
    return f"{year}_W{week:02d}"


def write_features(df: DataFrame, path: str, year: int, week: int) -> None:
    """Gzip JSON lines of GeoJSON features, by disease and horizon, under a versioned folder."""
    df.write.mode("overwrite").partitionBy("disease", "horizon").option("compression", "gzip").json(f"{path}/{version(year, week)}")


def write_serving_table(df: DataFrame, path: str, tile: float = 0.25) -> None:
    """Cells sorted by coarse tile and id, so that a viewport's ranges prune row groups."""
    tiled = df.withColumn("tx", F.floor(F.col("center_lon") / tile)).withColumn("ty", F.floor(F.col("center_lat") / tile))
    tiled.repartitionByRange("tx", "ty").sortWithinPartitions("tx", "ty", "cell").write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small report table as Markdown; more than `most` rows are an error, not a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
