"""Dense weekly panels: completion, lags, rolling windows, leads, interpolation, splits, disaggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def dense_weeks(rows: DataFrame, keys: list[str], value: str, monday: str = "monday") -> DataFrame:
    """A row for each key and each Monday of the span of the data, 0 where there was none.

    The calendar is one generated row; keys are exploded over it, so nothing is cross joined but that row.
    """
    span = rows.agg(F.min(monday).alias("__a"), F.max(monday).alias("__b"))
    weeks = span.select(F.sequence("__a", "__b", F.expr("interval 7 days")).alias("__weeks"))
    grid = rows.select(*keys).distinct().join(F.broadcast(weeks)).select(*keys, F.explode("__weeks").alias(monday))
    return grid.join(rows, [*keys, monday], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def by_time(keys: list[str], time: str = "monday") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def lags(panel: DataFrame, keys: list[str], value: str, steps: list[int], time: str = "monday") -> DataFrame:
    """value_lag_k on a dense panel."""
    w = by_time(keys, time)
    return panel.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in steps})


def leads(panel: DataFrame, keys: list[str], value: str, steps: list[int], time: str = "monday") -> DataFrame:
    """value_lead_k, the forecast targets, on a dense panel."""
    w = by_time(keys, time)
    return panel.withColumns({f"{value}_lead_{k}": F.lead(value, k).over(w) for k in steps})


def past(keys: list[str], n: int, time: str = "monday") -> WindowSpec:
    """The n periods before the current one, which itself is never seen."""
    return by_time(keys, time).rowsBetween(-n, -1)


def rolling_cases(panel: DataFrame, keys: list[str], value: str, time: str = "monday") -> DataFrame:
    """Rolling means over 4 and 12 past weeks, deviation over 4, and momentum lag 1 - lag 4."""
    w = by_time(keys, time)
    return panel.withColumns({
        f"{value}_roll_mean_4w": F.avg(value).over(past(keys, 4, time)),
        f"{value}_roll_mean_12w": F.avg(value).over(past(keys, 12, time)),
        f"{value}_roll_std_4w": F.stddev_samp(value).over(past(keys, 4, time)),
        f"{value}_momentum_4w": F.lag(value, 1).over(w) - F.lag(value, 4).over(w),
    })


def rolling_sum(panel: DataFrame, keys: list[str], value: str, spans: list[int], time: str = "monday") -> DataFrame:
    return panel.withColumns({f"{value}_roll_sum_{n}w": F.sum(value).over(past(keys, n, time)) for n in spans})


def weekly_weather(daily: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Rain sums (0 for a week without a value) and mean temperatures by ISO week."""
    monday = F.date_trunc("week", date).cast("date")
    return daily.groupBy(*keys, monday.alias("monday")).agg(
        F.coalesce(F.sum("rain"), F.lit(0.0)).alias("rain"), F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin")
    )


def interpolate(points: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Linear interpolation for each integer time between a key's first and last known values."""
    w = Window.partitionBy(*keys).orderBy(time)
    after = points.withColumn("__t1", F.lead(time).over(w)).withColumn("__v1", F.lead(value).over(w))
    last = F.when(F.col("__t1").isNull(), F.col(time)).otherwise(F.col("__t1") - 1)
    each = after.withColumn("__t", F.explode(F.sequence(F.col(time), last)))
    slope = F.coalesce(F.try_divide(F.col("__v1") - F.col(value), (F.col("__t1") - F.col(time)).cast("double")), F.lit(0.0))
    return each.select(*keys, F.col("__t").alias(time), (F.col(value) + slope * (F.col("__t") - F.col(time))).alias(value))


def split_of(year: Column, train_to: int, validate_to: int) -> Column:
    return F.when(year <= train_to, "train").when(year <= validate_to, "validation").otherwise("test")


def spatial_holdout(keys: list[str], percent: int = 15) -> Column:
    """Whether a place belongs to the held-out share; decided by its name alone, alike in any engine."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 8), 16, 10).cast("long")
    return number % 100 < percent


def expanding_folds(panel: DataFrame, years: list[int], year: str = "year") -> DataFrame:
    """Rows with fold (the last training year) and part: train up to it, validate the year after."""
    folds = F.explode(F.array(*[F.lit(y) for y in years])).alias("fold")
    out = panel.select("*", folds).where(F.col(year) <= F.col("fold") + 1)
    return out.withColumn("part", F.when(F.col(year) <= F.col("fold"), "train").otherwise("validate"))


def mass_preserving(rows: DataFrame, group: list[str], weight: str, total: str, name: str = "share") -> DataFrame:
    """Spread a group's total over its rows by weight; a group without weight is spread evenly."""
    w = Window.partitionBy(*group)
    part = F.try_divide(F.col(weight), F.sum(weight).over(w))
    even = F.lit(1.0) / F.count(F.lit(1)).over(w)
    return rows.withColumn(name, F.coalesce(part, even) * F.col(total))
