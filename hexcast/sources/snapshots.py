"""Versioned serving tables: files along a space-filling curve, a manifest of their ranges, atomic versions.

A version is a folder of data files, a manifest with a row for each file (its ranges, rows and largest measures), and an entry in
the log that names both. The entry is created under the next free number, which only one writer can do; readers take the
highest number or a pinned one, and nothing that an entry names is ever changed. A reader of a box reads the manifest first and
opens only the files whose ranges meet the box.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BITS = 16  # of each coordinate on the curve
ROWS_PER_FILE = 250_000


@dataclass(frozen=True)
class Snapshot:
    """One published version: everything that a reader needs to know, apart from the manifest's rows."""

    version: int
    data: str
    manifest: str
    schema: str
    rows: int
    largest: dict[str, float] = field(default_factory=dict)
    token: str | None = None


def _log(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_log")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, ascending; empty where nothing was published."""
    files, folder = _log(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The latest version, or a given one; later publishing does not change what it names."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version{'' if version is None else f' {version}'}")
    entry = spark.read.text(f"{path}/_log/{version or known[-1]:012d}.json", wholetext=True).first()["value"]
    return Snapshot(**json.loads(entry))


def spread_bits(x: Column) -> Column:
    """The low 16 bits of a number, each followed by a zero bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve_place(x: Column, y: Column, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
    """Place on the Z-order curve of a point in the box; null coordinates come first."""
    cell = lambda v, a, b: F.least(F.lit((1 << BITS) - 1), F.floor(F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0)) * (1 << BITS))).cast("long")
    return spread_bits(cell(x, low_x, high_x)).bitwiseOR(F.shiftleft(spread_bits(cell(y, low_y, high_y)), 1))


def publish(rows: DataFrame, path: str, x: str, y: str, key: str, measures: list[str], token: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> Snapshot:
    """Write rows as the next version and return it.

    Files hold about rows_per_file rows that lie together on the curve over (x, y), sorted by it and by key, so that both a
    file's ranges and its row groups are small. A version with the same token as the latest is not written twice, so a
    micro-batch that is replayed after a failure changes nothing. Rows without coordinates are kept; an empty relation
    gives a version without rows. Unfinished writes leave files that no entry names.
    """
    spark = rows.sparkSession
    if token is not None and (known := versions(spark, path)):
        latest = snapshot(spark, path, known[-1])
        if latest.token == token:
            return latest
    data, manifest = f"{path}/data-{uuid.uuid4().hex}", f"{path}/manifest-{uuid.uuid4().hex}"
    span = rows.agg(*[f(c).cast("double") for c in (x, y) for f in (F.min, F.max)], F.count(F.lit(1))).first()  # one row
    edges = [F.lit(v).cast("double") for v in span[:4]]
    files = max(1, -(-span[4] // rows_per_file))
    placed = rows.withColumn("__curve", curve_place(F.col(x), F.col(y), *edges))
    placed.repartitionByRange(files, "__curve", key).sortWithinPartitions("__curve", key).drop("__curve").write.option("compression", "zstd").parquet(data)

    stored = spark.read.schema(rows.schema).parquet(data)
    ranges = [f(c).cast("double").alias(f"{n}_{c}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))]
    per_file = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ranges, *[F.max(m).cast("double").alias(f"most_{m}") for m in measures])
    per_file.write.parquet(manifest)  # a row for each file
    listed = spark.read.schema(per_file.schema).parquet(manifest)
    whole = listed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.max(f"most_{m}").alias(m) for m in measures]).first()
    entry = {"data": data, "manifest": manifest, "schema": rows.schema.json(), "rows": whole["rows"], "largest": {m: whole[m] for m in measures}, "token": token}
    return _commit(spark, path, entry)


def _commit(spark: SparkSession, path: str, entry: dict) -> Snapshot:
    """Create the log's next entry: write it aside, then rename it to a number that is still free."""
    files, folder = _log(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    while True:
        version = (versions(spark, path) or [0])[-1] + 1
        made = Snapshot(version=version, **entry)
        aside = hadoop.Path(folder, f"_{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(bytearray(json.dumps(made.__dict__).encode()))
        out.close()
        try:
            # a link or rename onto an existing name fails, so one of two writers of a number goes on to the next
            target = hadoop.Path(folder, f"{version:012d}.json")
            if not files.exists(target) and files.rename(aside, target):
                return made
        except Py4JJavaError:
            if not files.exists(hadoop.Path(folder, f"{version:012d}.json")):
                raise
        files.delete(aside, False)


def read(spark: SparkSession, at: Snapshot) -> DataFrame:
    return spark.read.schema(_schema(at)).parquet(at.data)


def _schema(at: Snapshot) -> StructType:
    return StructType.fromJson(json.loads(at.schema))


def files_in_box(spark: SparkSession, at: Snapshot, x: str, y: str, box: tuple[float, float, float, float], margin: float = 0.0, above: tuple[str, float] | None = None) -> list[str]:
    """The files of a version with a point in the box (west, south, east, north) widened by margin.

    `above` names a measure and a bound: files without a larger value are left out too.
    """
    west, south, east, north = box
    listed = spark.read.parquet(at.manifest)
    near = (F.col(f"high_{x}") >= west - margin) & (F.col(f"low_{x}") <= east + margin) & (F.col(f"high_{y}") >= south - margin) & (F.col(f"low_{y}") <= north + margin)
    if above:
        near &= F.col(f"most_{above[0]}") > above[1]
    return sorted(r["file"] for r in listed.where(near).select("file").collect())  # the files that the box needs


def read_box(spark: SparkSession, at: Snapshot, x: str, y: str, box: tuple[float, float, float, float], margin: float = 0.0, above: tuple[str, float] | None = None) -> DataFrame:
    """Rows of a version in the box widened by margin; only the files whose ranges meet it are listed and opened."""
    west, south, east, north = box
    schema = _schema(at)
    files = files_in_box(spark, at, x, y, box, margin, above)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    inside = F.col(x).between(west - margin, east + margin) & F.col(y).between(south - margin, north + margin)
    return rows.where(inside & (F.col(above[0]) > above[1]) if above else inside)


def vacuum(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Forget all but the last `keep` versions and delete their files; gives the versions that are left.

    Entries go first, so no reader finds a version whose files are gone; readers pinned to a forgotten one fail.
    """
    files, folder = _log(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    known = versions(spark, path)
    for version in known[: len(known) - max(1, keep)]:
        old = snapshot(spark, path, version)
        files.delete(hadoop.Path(folder, f"{version:012d}.json"), False)
        for part in (old.manifest, old.data):
            files.delete(hadoop.Path(part), True)
    return versions(spark, path)
