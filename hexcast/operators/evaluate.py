"""Forecast evaluation and data profiles: confusion, lead time, regression, intervals, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.functions.exprs import col, ratio
from hexcast.session import materialised


def with_splits(rows: DataFrame, holdout: str, names: tuple[str, str, str] = ("all", "holdout", "seen")) -> DataFrame:
    """Each row once in `all` and once in its own part, in one pass."""
    every, held, seen = names
    return rows.select("*", F.explode(F.array(F.lit(every), F.when(F.col(holdout), held).otherwise(seen))).alias("split"))


def confusion(rows: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, iou (0 where a denominator is 0; 4 digits)."""
    a, p = F.col(actual), F.col(predicted)
    counts = rows.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)}
    return counts.select("*", *[F.round(c, 4).alias(n) for n, c in scores.items()])


def detection_rates(rows: DataFrame, actual: str, predicted: str, lead: str) -> DataFrame:
    """Share of actual hot spots that each lead time's forecast has found (4 digits)."""
    hits = rows.groupBy(lead).agg(F.count_if(F.col(actual)).alias("actual_n"), F.count_if(F.col(actual) & F.col(predicted)).alias("detected_n"))
    return hits.withColumn("rate", F.round(ratio("detected_n", "actual_n"), 4))


def max_effective_lead(rates: DataFrame, lead: str, least: float = 0.5) -> DataFrame:
    """One row: the longest lead with a rate of at least `least`, else 0."""
    return rates.agg(F.coalesce(F.max(F.when(F.col("rate") >= least, F.col(lead))), F.lit(0)).alias("max_lead"))


def value_counts(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, percent): percent of all rows, null labels counted in the denominator only."""
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    return counts.select(label, "n", F.round(ratio("n", "__n") * 100, 2).alias("percent")).orderBy(F.desc("n"), label)


def correlation(a: str | Column, b: str | Column) -> Column:
    """Aggregate: Pearson correlation, null for constant inputs (corr() itself fails on them in ANSI mode)."""
    return F.try_divide(F.covar_pop(col(a), col(b)), F.stddev_pop(col(a)) * F.stddev_pop(col(b)))


def regression(actual: str | Column, predicted: str | Column) -> dict[str, Column]:
    """Aggregates r2, mae, rmse, corr and rmsle of predictions clamped at 0.

    r2 is null for constant actuals; corr is 0 for (nearly) constant predictions.
    """
    y, p = col(actual).cast("double"), F.greatest(F.lit(0.0), col(predicted).cast("double"))
    error = y - p
    logs = F.log1p(F.greatest(F.lit(0.0), y)) - F.log1p(p)
    return {
        "r2": F.lit(1.0) - F.try_divide(F.avg(error * error), F.var_pop(y)),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "corr": F.when(F.stddev_pop(p) > 1e-9, correlation(y, p)).otherwise(0.0),
        "rmsle": F.sqrt(F.avg(logs * logs)),
    }


def regression_metrics(rows: DataFrame, keys: list[str], actual: str, predicted: str, digits: int = 6) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.round(c, digits).alias(n) for n, c in regression(actual, predicted).items()])


def interval_coverage(rows: DataFrame, levels: list[int]) -> DataFrame:
    """One row: share of actuals within each interval; bounds count, a missing bound does not cover."""
    inside = {f"coverage_{k}": F.col("actual").between(F.col(f"lower_{k}"), F.col(f"upper_{k}")) for k in levels}
    mae = F.avg(F.abs(F.col("prediction") - F.col("actual")))
    return rows.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in inside.items()], mae.alias("mae"))


def exact_quantiles(rows: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """(group, q): exact quantiles (array, interpolated) of a value in each group; nulls do not count.

    Equal values are counted first, their counts are range-partitioned and summed by partition, and the ranks
    next to each quantile are then looked up, so a group of any size is never in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialised(counts.repartitionByRange(n, "g", "v").withColumn("part", F.spark_partition_id()))
    # one row for each group and partition that holds it
    parts = counts.groupBy("g", "part").agg(F.sum("n").alias("s"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy("g")).alias("total"))
    within = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("stop", F.sum("n").over(within)).join(parts, ["g", "part"]).withColumn("stop", F.col("base") + F.col("stop"))
    at = lambda rank: F.max(F.when((F.col("stop") - F.col("n") <= rank) & (rank < F.col("stop")), F.col("v").cast("double")))
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    sums = [x for k, p in enumerate(points) for x in (at(F.floor(place(p))).alias(f"low{k}"), at(F.ceil(place(p))).alias(f"high{k}"), F.max(place(p) - F.floor(place(p))).alias(f"part{k}"))]
    mixed = [F.col(f"low{k}") * (1 - F.col(f"part{k}")) + F.col(f"high{k}") * F.col(f"part{k}") for k in range(len(points))]
    return placed.groupBy("g").agg(*sums).select(F.col("g").alias(group), F.array(*mixed).alias("q"))


def quantile(rows: DataFrame, value: str, point: float, name: str) -> DataFrame:
    """One row: an exact quantile of a value over all rows."""
    found = exact_quantiles(rows.select(F.lit(0).alias("all"), F.col(value).alias("value")), "all", "value", [point])
    return found.select(F.col("q")[0].alias(name))


def width_quantiles(rows: DataFrame, low: str, high: str) -> DataFrame:
    """One row: mean and exact quantiles of the interval width."""
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    widths = rows.select(F.lit(0).alias("all"), (F.col(high) - F.col(low)).alias("width"))
    q = exact_quantiles(widths, "all", "width", list(points.values()))
    # one row each
    out = widths.agg(F.avg("width").alias("mean")).join(F.broadcast(q))
    return out.select("mean", *[F.col("q")[k].alias(n) for k, n in enumerate(points)])


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the position (from 1) in a total order of all rows.

    Rows are range-partitioned by the order and written once; partitions are then numbered from their
    counts, one row for each partition, and ranked within themselves. No task sees the whole relation.
    """
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = materialised(ranged.withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    bases = bases.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    placed = ranged.join(F.broadcast(bases), "__part")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn(name, F.col("__base") + own).drop("__part", "__base")


def with_average_rank(rows: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Add the rank of a value, ties at their mean."""
    ranked = global_rank(rows, [F.asc(value), F.asc(key)], "__rank")
    ties = ranked.groupBy(value).agg(F.avg("__rank").alias(name))
    return ranked.drop("__rank").join(ties, value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson and Spearman correlation (average ranks on ties)."""
    keyed = rows.select(a, b).withColumn("__key", F.monotonically_increasing_id())
    both = with_average_rank(with_average_rank(keyed, a, "__key", "__ra"), b, "__key", "__rb")
    return both.agg(correlation(a, b).alias("pearson"), correlation("__ra", "__rb").alias("spearman"))


def top_share_overlap(rows: DataFrame, a: str, b: str, key: str, share: float = 0.1) -> DataFrame:
    """One row: how many of the top share by a are also in the top share by b."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(share) * F.count(F.lit(1))).cast("long"))
    ranked = global_rank(global_rank(rows.select(key, a, b), [F.desc(a), F.asc(key)], "__ra"), [F.desc(b), F.asc(key)], "__rb")
    counted = ranked.join(F.broadcast(rows.agg(n.alias("size"))))
    common = F.count_if((F.col("__ra") <= F.col("size")) & (F.col("__rb") <= F.col("size")))
    return counted.agg(common.alias("common"), F.max("size").alias("size")).withColumn("overlap", F.round(ratio("common", "size"), 4))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, null_percent, min, max, mean, std) of numeric columns, in one pass."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    out = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    return out.withColumn("null_percent", F.round(ratio("nulls", "n") * 100, 2))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) with exact quantiles."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    q = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    # one row for each column
    q = q.join(F.broadcast(exact_quantiles(long, "column", "value", [0.25, 0.5, 0.75])), "column", "left")
    return q.select("column", "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, null_percent) of the columns that have nulls."""
    long = rows.select(*[F.col(c).isNull().cast("int").alias(c) for c in columns]).unpivot([], columns, "column", "missing")
    out = long.groupBy("column").agg(F.sum("missing").alias("nulls"), F.count(F.lit(1)).alias("__n")).where("nulls > 0")
    return out.select("column", "nulls", F.round(ratio("nulls", "__n") * 100, 2).alias("null_percent"))


def target_stats(rows: DataFrame, targets: list[str]) -> DataFrame:
    """(target, mean, max, percent_positive)."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in targets]).unpivot([], targets, "target", "value")
    positive = F.avg((F.col("value") > 0).cast("double")) * 100
    return long.groupBy("target").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.round(positive, 2).alias("percent_positive"))


def above_quantile(rows: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """One row: the quantile, and how many rows lie strictly above it."""
    cut = quantile(rows, value, share, "cut")
    out = rows.join(F.broadcast(cut)).agg(F.max("cut").alias("cut"), F.count_if(F.col(value) > F.col("cut")).alias("above"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(ratio("above", "n"), 6))


def coverage(rows: DataFrame, year: str, week: str, key: str) -> DataFrame:
    """One row: distinct periods and keys, first and last period."""
    return rows.agg(
        F.countDistinct(key).alias("keys"), F.countDistinct(year).alias("years"), F.countDistinct(year, week).alias("periods"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min(week).alias("first_week"), F.max(week).alias("last_week"),
    )


def group_extremes(rows: DataFrame, group: str) -> DataFrame:
    """One row: size statistics of groups with the largest and the smallest one (ties by name)."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.min("n").alias("smallest_n"), F.percentile("n", 0.5).alias("median_n"), F.max("n").alias("largest_n"),
        F.min(F.struct(-F.col("n"), group))[group].alias("largest"), F.min(F.struct("n", group))[group].alias("smallest"),
    )
