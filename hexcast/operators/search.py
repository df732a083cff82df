"""Place index and search over districts, states and cell ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.functions.exprs import district_score, normalised, state_score


def _extent() -> list:
    parts = [("center_lat", F.avg, "center_lat"), ("center_lon", F.avg, "center_lon"), ("min_lon", F.min, "center_lon"), ("min_lat", F.min, "center_lat")]
    parts += [("max_lon", F.max, "center_lon"), ("max_lat", F.max, "center_lat")]
    return [F.round(f(c), 5).alias(n) for n, f, c in parts]


def district_index(cells: DataFrame) -> DataFrame:
    return cells.groupBy("district", "state").agg(*_extent(), F.count(F.lit(1)).alias("cell_count"))


def state_index(cells: DataFrame) -> DataFrame:
    return cells.groupBy("state").agg(*_extent(), F.countDistinct("district").alias("district_count"), F.count(F.lit(1)).alias("cell_count"))


def search_districts(districts: DataFrame, query: str, limit: int) -> DataFrame:
    """Districts by match quality, then size, then name."""
    found = districts.withColumn("score", district_score("district", "state", query)).where("score > 0")
    return found.orderBy(F.desc("score"), F.desc("cell_count"), "district", "state").limit(limit)


def search_states(states: DataFrame, query: str, limit: int = 4) -> DataFrame:
    found = states.withColumn("score", state_score("state", query)).where("score > 0")
    return found.orderBy(F.desc("score"), F.desc("cell_count"), "state").limit(limit)


def search_cells(cells: DataFrame, query: str, limit: int = 5, key: str = "hex") -> DataFrame:
    """The first cells whose id starts with the text; a whole id finds only itself."""
    q = normalised(query)
    if len(q) == 15:
        return cells.where(F.col(key) == q)
    if len(q) < 6:
        return cells.limit(0)
    return cells.where(F.col(key).startswith(q)).orderBy(key).limit(limit)


def popular(districts: DataFrame, names: list[str]) -> DataFrame:
    """For each wanted name its first match: exact, else prefix, else substring; then the larger district."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("wanted")) for k, n in enumerate(names)]))
    rows = districts.select("*", wanted.alias("w")).select("*", "w.*").drop("w")
    d, w = F.lower("district"), F.lower("wanted")
    kind = F.when(d == w, 0).when(d.startswith(w), 1).when(d.contains(w), 2)
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    best = F.min(F.struct("kind", (-F.col("cell_count")).alias("size"), "district", "state")).alias("b")
    return rows.groupBy("position", "wanted").agg(best).select("position", "wanted", "b.district", "b.state", (-F.col("b.size")).alias("cell_count"))
