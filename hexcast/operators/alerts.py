"""Alerts: growth and levels, state tables, persistence runs and the taxonomy of hot spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.functions.exprs import alert_level, growth_percent

LEVELS = (0, 1, 2, 3)


def with_alerts(rows: DataFrame, predicted: str, current: str, z: str, taxonomy: str) -> DataFrame:
    """Add growth (percent) and alert_level (0 to 3)."""
    grown = rows.withColumn("growth", growth_percent(predicted, current))
    return grown.withColumn("alert_level", alert_level(z, taxonomy, "growth"))


def level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_level").agg(F.count(F.lit(1)).alias("n")).orderBy("alert_level")


def state_table(alerts: DataFrame, state: str = "state") -> DataFrame:
    """A row for each state, a column for each level."""
    counts = alerts.groupBy(state).pivot("alert_level", list(LEVELS)).count().fillna(0)
    return counts.select(state, *[F.col(str(k)).alias(f"level_{k}") for k in LEVELS])


def summary(alerts: DataFrame) -> DataFrame:
    """One row: the number of cells at each level."""
    return alerts.agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("alert_level") == k).alias(f"level_{k}") for k in LEVELS])


def strongest(alerts: DataFrame, n: int, z: str = "z", key: str = "cell") -> DataFrame:
    return alerts.where("alert_level > 0").orderBy(F.desc("alert_level"), F.desc(z), key).limit(n)


def growth_histogram(alerts: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of growth below `high`; bins count from 1, lower values are in bin 0."""
    rows = alerts.where(F.col("growth") < high)
    return rows.groupBy(F.width_bucket("growth", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def persistence_runs(flags: DataFrame, keys: list[str], week: str = "week_index") -> DataFrame:
    """Runs of consecutive weeks in rows that are all hot: first, last, length."""
    w = Window.partitionBy(*keys).orderBy(week)
    rows = flags.withColumn("__island", F.col(week) - F.row_number().over(w))
    runs = rows.groupBy(*keys, "__island").agg(F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.count(F.lit(1)).alias("weeks"))
    return runs.drop("__island")


def taxonomy(panel: DataFrame, keys: list[str], z: str = "z", week: str = "week_index", hot: float = 1.96, lasting: int = 3) -> DataFrame:
    """Label of each key at its last week.

    Persistent: hot for `lasting` weeks in a row; Emerging: hot now but not before; Intensifying: hot twice
    with rising z; Diminishing: hot before but not now; else Non-Hotspot. Weeks must be dense.
    """
    w = Window.partitionBy(*keys).orderBy(week)
    before = [F.coalesce(F.lag(z, k).over(w), F.lit(0.0)) for k in range(1, lasting)]
    rows = panel.select("*", *[b.alias(f"__z{k}") for k, b in enumerate(before, 1)])
    now = F.col(z) > hot
    all_hot = now
    for k in range(1, lasting):
        all_hot = all_hot & (F.col(f"__z{k}") > hot)
    was = F.col("__z1") > hot
    label = F.when(all_hot, "Persistent").when(now & was & (F.col(z) > F.col("__z1")), "Intensifying").when(now, "Emerging").when(was, "Diminishing").otherwise("Non-Hotspot")
    rows = rows.withColumn("taxonomy", label)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(z, "taxonomy"), week).alias("l")).select(*keys, f"l.{z}", "l.taxonomy")


def priority(rows: DataFrame, group: str, band: str) -> DataFrame:
    """Groups with a high or medium band, most high ones first: (group, high_alert, warning)."""
    out = rows.groupBy(group).agg(F.count_if(F.col(band) == "high").alias("high_alert"), F.count_if(F.col(band) == "medium").alias("warning"))
    return out.where("high_alert > 0 or warning > 0").orderBy(F.desc("high_alert"), F.desc("warning"), group)
