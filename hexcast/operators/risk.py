"""Risk surfaces: latest period, grid completion, fusion of two diseases, top-N, viewport, rollup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.functions.exprs import closed_ring, hybrid_risk, positive_max, risk_percent, syndemic_normalised, syndemic_raw

HALF_BOX = 0.016
LIMITS = (100, 25000)


def latest_period(panel: DataFrame, year: str = "year", week: str = "week") -> DataFrame:
    """Rows of the last week within the last year."""
    last = panel.agg(F.max(F.struct(year, week)).alias("last"))
    return panel.join(F.broadcast(last), F.struct(panel[year], panel[week]) == F.col("last")).drop("last")


def on_full_grid(grid: DataFrame, risk: DataFrame, value: str, key: str = "cell") -> DataFrame:
    """Every grid cell with its risk, 0 where there is none."""
    return grid.join(risk, key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def above(rows: DataFrame, value: str, least: float = 0.001) -> DataFrame:
    return rows.where(F.col(value) > least)


def with_percent(rows: DataFrame, value: str, name: str = "risk_percent") -> DataFrame:
    """Add the share of the relation's own largest value, in percent."""
    largest = rows.agg(positive_max(value).alias("__largest"))
    return rows.join(F.broadcast(largest)).withColumn(name, risk_percent(value, "__largest")).drop("__largest")


def top_n(rows: DataFrame, value: str, n: int, key: str = "cell") -> DataFrame:
    """The n largest, ties by ascending key."""
    return rows.orderBy(F.desc(value), F.asc(key)).limit(n)


def syndemic(a: DataFrame, b: DataFrame, key: str = "cell") -> DataFrame:
    """Both diseases' cells with syndemic risk relative to the maxima of the joined rows."""
    both = a.join(b, key)
    largest = both.agg(positive_max("a").alias("__max_a"), positive_max("b").alias("__max_b"))
    fused = both.join(F.broadcast(largest)).withColumn("syndemic", syndemic_normalised("a", "__max_a", "b", "__max_b"))
    return fused.drop("__max_a", "__max_b")


def history(panel: DataFrame, value: str, n: int = 12, year: str = "year", week: str = "week") -> DataFrame:
    """Means of the last n periods, in ascending order."""
    means = panel.groupBy(year, week).agg(F.avg(value).alias(value))
    return means.orderBy(F.desc(year), F.desc(week)).limit(n).orderBy(year, week)


def syndemic_history(a: DataFrame, b: DataFrame) -> DataFrame:
    """Unnormalised fusion of two histories, aligned on (year, week)."""
    return a.join(b, ["year", "week"]).withColumn("syndemic", syndemic_raw("a", "b"))


def box_arguments(west: float, south: float, east: float, north: float, limit: int) -> tuple:
    """Bounds in order and the limit within LIMITS."""
    low, high = LIMITS
    return min(west, east), min(south, north), max(west, east), max(south, north), min(high, max(low, limit))


def in_box(rows: DataFrame, west: float, south: float, east: float, north: float, lon: str = "center_lon", lat: str = "center_lat") -> DataFrame:
    """Rows whose box (centre +- HALF_BOX) overlaps the given one; all edges count.

    Written as ranges of the bare columns, so that they reach the Parquet scan.
    """
    half = F.lit(HALF_BOX)
    wide = F.col(lon).between(west - HALF_BOX - 1e-9, east + HALF_BOX + 1e-9) & F.col(lat).between(south - HALF_BOX - 1e-9, north + HALF_BOX + 1e-9)
    exact = (F.col(lon) + half >= west) & (F.col(lon) - half <= east) & (F.col(lat) + half >= south) & (F.col(lat) - half <= north)
    return rows.where(wide & exact)


def viewport(rows: DataFrame, value: str, box: tuple, largest: float | Column, state: str | None = None, key: str = "cell") -> DataFrame:
    """Cells of a map view with positive risk: the first `limit` by key, with percent of a stored maximum."""
    west, south, east, north, limit = box_arguments(*box)
    seen = in_box(rows, west, south, east, north).where(F.col(value) > 0)
    if state:
        seen = seen.where(F.col("state") == state)
    seen = seen.orderBy(key).limit(limit)
    return seen.withColumn("risk_percent", risk_percent(value, F.lit(largest) if isinstance(largest, float) else largest))


def chosen_state(state: str, priority: list[str]) -> Column:
    """Aggregate: the first state of a priority list that occurs, else the most frequent (ties: the least)."""
    hubs = [F.max(F.when(F.col(state) == h, F.lit(h))) for h in priority]
    return F.coalesce(*hubs, F.mode(state, True))


def overview(rows: DataFrame, parent: list[str], measures: list[str], priority: list[str], key: str = "cell") -> DataFrame:
    """Parent cells: count, centre, first district by key, chosen state, and mean, maximum, hybrid and percent.

    The percent is relative to the largest single cell.
    """
    stats = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("max", F.max))]
    groups = rows.groupBy(*parent).agg(
        F.count(F.lit(1)).alias("cell_count"), F.avg("center_lat").alias("center_lat"), F.avg("center_lon").alias("center_lon"),
        F.min_by("district", key).alias("district"), chosen_state("state", priority).alias("state"), *stats,
    )
    largest = rows.agg(*[positive_max(m).alias(f"__{m}") for m in measures])
    groups = groups.join(F.broadcast(largest))
    for m in measures:
        groups = groups.withColumn(f"{m}_hybrid", hybrid_risk(f"{m}_mean", f"{m}_max"))
        groups = groups.withColumn(f"{m}_percent", risk_percent(f"{m}_hybrid", f"__{m}"))
    return groups.drop(*[f"__{m}" for m in measures])


def long_form(rows: DataFrame, keys: list[str], measures: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    return rows.unpivot(keys, measures, name, value)


def top_of_group(rows: DataFrame, group: list[str], value: str, key: str = "cell") -> DataFrame:
    """The largest row of each group, ties by ascending key; combines map-side, so groups may be of any size."""
    rest = [c for c in rows.columns if c not in group]
    best = rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(key))).alias("__best"))
    return best.select(*group, "__best.*")


def features(rows: DataFrame, properties: list[str], lon: str = "center_lon", lat: str = "center_lat") -> DataFrame:
    """(feature): a GeoJSON point feature for each row."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(*properties[:1], F.to_json(body).alias("feature"))


def polygon_features(rows: DataFrame, properties: list[str], lon: str = "center_lon", lat: str = "center_lat", aggregate: bool = False, **size: float) -> DataFrame:
    """(first property, feature): a GeoJSON polygon feature of each cell's hexagon."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(closed_ring(lon, lat, **size)).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties, F.lit(aggregate).alias("is_aggregate")).alias("properties"))
    return rows.select(*properties[:1], F.to_json(body).alias("feature"))


def at_all_horizons(cells: DataFrame, predictions: DataFrame, value: str, horizons: list[int]) -> DataFrame:
    """Every cell at every horizon: the prediction (0 where none) and its percent of the horizon's largest."""
    grid = cells.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    rows = grid.join(predictions, ["cell", "horizon"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    largest = predictions.groupBy("horizon").agg(positive_max(value).alias("__largest"))
    # one row for each horizon
    rows = rows.join(F.broadcast(largest), "horizon", "left").withColumn("__largest", F.coalesce("__largest", F.lit(1.0)))
    return rows.withColumn("risk_percent", risk_percent(value, "__largest")).drop("__largest")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return rows.orderBy(*order).limit(n)


DISEASES, HORIZONS = ("a", "b"), (1, 2, 3, 4)


def checked(disease: str, horizon: int) -> tuple[str, int]:
    """The arguments of a request; ValueError for an unknown disease or horizon, before anything is planned."""
    if disease not in DISEASES:
        raise ValueError(f"unknown disease {disease!r}: one of {', '.join(DISEASES)}")
    if horizon not in HORIZONS:
        raise ValueError(f"horizon {horizon} is not from {HORIZONS[0]} to {HORIZONS[-1]}")
    return disease, horizon


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hash_sample(rows: DataFrame, n: int, key: str = "cell", seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones whatever the partitions: least hash of an integer key first."""
    mixed = F.pmod((F.col(key) + seed) * F.lit(2654435761), F.lit(4294967296))
    return rows.orderBy(mixed, key).limit(n)


def keep_one(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row for each key: the highest priority; combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(priority, *[c for c in rest if c != priority])).alias("__best"))
    return best.select(*keys, *[f"__best.{c}" for c in rest])


def simulated_history(rows: DataFrame, keys: list[str], value: str, weeks: int = 11) -> DataFrame:
    """Demo only: weeks before a single known one, with hashed noise, marked is_simulated."""
    back = F.explode(F.sequence(F.lit(0), F.lit(weeks))).alias("ago")
    out = rows.select("*", back)
    noise = F.pmod(F.xxhash64(*keys, "ago"), F.lit(1000)) / 1000.0
    out = out.withColumn(value, F.when(F.col("ago") == 0, F.col(value)).otherwise(F.greatest(F.lit(0.0), F.col(value) * (0.7 + 0.6 * noise))))
    return out.withColumn("week", F.pmod(F.col("week") - 1 - F.col("ago"), F.lit(52)) + 1).withColumn("is_simulated", F.col("ago") > 0).drop("ago")
