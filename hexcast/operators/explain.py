"""Explanations: global importance, local top features, merging and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_importance(values: DataFrame, keys: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean absolute contribution of each feature (nulls count as rows), with its rank."""
    sums = values.groupBy(*keys, feature).agg((F.sum(F.abs(value)) / F.count(F.lit(1))).alias("importance"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("importance"), feature)))


def local_top(values: DataFrame, cell, n: int = 15, key: str = "cell", feature: str = "feature", value: str = "value") -> DataFrame:
    """The n features with the largest absolute contribution to one cell."""
    rows = values.where(F.col(key) == cell).select(feature, value, F.abs(value).alias("size"))
    return rows.orderBy(F.desc("size"), feature).limit(n)


def with_fallback(grid: DataFrame, values: DataFrame, n: int = 15, key: str = "cell", feature: str = "feature", value: str = "value") -> DataFrame:
    """(cell, source, rank, feature, importance): the n most important features of every cell of the grid.

    A cell with contributions of its own is explained by them (source local, absolute value), any other by the mean
    absolute contributions of all cells (global, at most n rows and so broadcast). Ties go by feature; a cell that
    no feature is known for has no row.
    """
    size = F.abs(value)
    cells = grid.select(key).distinct()
    order = Window.partitionBy(key).orderBy(F.desc("importance"), feature)
    own = values.select(key, feature, size.alias("importance")).join(cells, key, "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    whole = global_importance(values.withColumn("__all", F.lit(1)), ["__all"], feature, value).where(F.col("rank") <= n)
    rest = cells.join(values.select(key), key, "left_anti").join(F.broadcast(whole.drop("__all")))
    columns = [key, "source", "rank", feature, "importance"]
    return own.withColumn("source", F.lit("local")).select(*columns).unionByName(rest.withColumn("source", F.lit("global")).select(*columns))


def merged(a: DataFrame, b: DataFrame, n: int = 15, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Half-weighted union of two importance lists; a missing side counts 0."""
    both = a.select(feature, value).unionByName(b.select(feature, value))
    return both.groupBy(feature).agg(F.sum(F.col(value) / 2).alias(value)).orderBy(F.desc(value), feature).limit(n)


def shares(ranked: DataFrame, n: int = 10, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Impact share (0.1 to 99.9) and bar length (6 to 100) of the n most important features."""
    top = ranked.orderBy(F.desc(value), feature).limit(n)
    whole = Window.partitionBy(F.lit(0))  # n rows
    impact = F.least(F.lit(99.9), F.greatest(F.lit(0.1), F.col(value) / F.sum(value).over(whole) * 100))
    bar = F.least(F.lit(100.0), F.greatest(F.lit(6.0), F.col(value) / F.max(value).over(whole) * 100))
    return top.select(feature, value, F.round(impact, 4).alias("impact"), F.round(bar, 4).alias("bar"))


def feature_group(name: str) -> str:
    """Ablation group of a feature, by its name."""
    rules = (("neighbor", "Spatial"), ("case", "History"), ("rain", "Rain"), ("tm", "Temperature"), ("suitability", "Suitability"), ("pop", "Population"))
    if name in ("sin_week", "cos_week"):
        return "Season"
    if name.startswith(("frac_", "ndvi")):
        return "Land"
    return next((g for part, g in rules if part in name), "Misc")


#: the six ablation scenarios: the group left out, or the only one kept
#: fixed values: names of the scenarios
SCENARIOS = {
    "All Features (Baseline)": (None, None), "No Weather": ("Weather", None), "No Spatial (Neighbors)": ("Spatial_Neighbors", None),
    "No Temporal (Seasonality)": ("Temporal_Seasonality", None), "No Ecology & Population": ("Ecology_Population", None),
    "Only Base Cases (No Exogenous)": (None, "Base_Cases"),
}
# fixed values: parts of feature names by ablation group
GROUP_PARTS = {
    "Weather": ("tmean", "tmin", "tmax", "rain", "humid", "suitability"),
    "Spatial_Neighbors": ("neighbor",),
    "Ecology_Population": ("pop", "frac_", "ndvi", "elevation"),
}


def ablation_groups(name: str) -> set[str]:
    """The ablation groups that a feature belongs to; it may be in several."""
    groups = {g for g, parts in GROUP_PARTS.items() if any(p in name for p in parts)}
    if "case" in name and "neighbor" not in name:
        groups.add("Base_Cases")
    if name in ("sin_week", "cos_week", "month"):
        groups.add("Temporal_Seasonality")
    return groups or {"Misc"}


def ablation_scenarios(features: list[str]) -> dict[str, list[str]]:
    """The features of each scenario."""
    groups = {f: ablation_groups(f) for f in features}
    return {name: [f for f, g in groups.items() if without not in g and (only is None or only in g)] for name, (without, only) in SCENARIOS.items()}


def environmental(features: list[str]) -> list[str]:
    """Features that hold no case history, own or neighbours'."""
    return [f for f in features if "case" not in f and "neighbor" not in f]
