"""Forecast models: baselines, tree models on the change of cases, scoring, ablation, disaggregation fit."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = ("cell", "state", "district", "year", "week", "monday", "week_index", "is_spatial_holdout", "split", "cases")


def feature_columns(df: DataFrame, drop: tuple[str, ...] = META) -> list[str]:
    """Everything but metadata and targets; freeze the list in a manifest for later scoring."""
    return [c for c in df.columns if c not in drop and not c.startswith(("target_", "outbreak_", "cases_lead_"))]


def naive(rows: DataFrame, last: str, name: str = "pred_naive") -> DataFrame:
    """The last known value, whatever the horizon."""
    return rows.withColumn(name, F.col(last))


def seasonal(train: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str = "pred_seasonal") -> DataFrame:
    """The training mean of a place and week; 0 where it was never seen."""
    means = train.groupBy(*keys).agg(F.avg(value).alias(name))
    return rows.join(means, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def with_missing(rows: DataFrame, features: list[str]) -> DataFrame:
    """All features as doubles; absent columns and nulls are 0."""
    have = set(rows.columns)
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in features})


def fit_delta(train: DataFrame, features: list[str], target: str, base: str, kind: str = "gbt", **params) -> PipelineModel:
    """A tree model of target - base. kind: gbt (boosted) or rf (forest)."""
    forms = {"gbt": (GBTRegressor, {"maxIter": 20, "maxDepth": 4, "seed": 1}), "rf": (RandomForestRegressor, {"numTrees": 20, "maxDepth": 6, "seed": 1})}
    make, defaults = forms[kind]
    rows = with_missing(train, features).withColumn("__delta", F.col(target) - F.col(base)).where("__delta is not null")
    assembler = VectorAssembler(inputCols=features, outputCol="__features")
    model = make(featuresCol="__features", labelCol="__delta", predictionCol="__change", **(defaults | params))
    return PipelineModel([assembler, model.fit(assembler.transform(rows))])


def score_delta(model: PipelineModel, rows: DataFrame, features: list[str], base: str, name: str) -> DataFrame:
    """Base plus predicted change, never below 0."""
    kept = rows.columns
    scored = model.transform(with_missing(rows, features))
    return scored.select(*kept, F.greatest(F.lit(0.0), F.coalesce(F.col(base), F.lit(0.0)) + F.col("__change")).alias(name))


def poisson_fit(rows: DataFrame, group: list[str], exposure: str, features: list[str], total: str, rounds: int = 25) -> list[float]:
    """Coefficients of a group-level Poisson model, the expected total being sum(exposure * exp(x b)).

    Fisher scoring; each step is one aggregation by group and one over groups, so only a few numbers reach the
    driver. The exponent is clipped to +-30, and a step that worsens the likelihood is halved.
    """
    beta = np.zeros(len(features))

    def pieces(b: np.ndarray, full: bool):
        eta = sum((F.col(f) * float(v) for f, v in zip(features, b, strict=True)), F.lit(0.0))
        mu = F.col(exposure) * F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)))
        by_group = rows.groupBy(*group).agg(F.sum(mu).alias("m"), F.max(total).alias("y"), *[F.sum(mu * F.col(f)).alias(f"g{k}") for k, f in enumerate(features)])
        loss = F.sum(F.col("m") - F.col("y") * F.log(F.greatest(F.col("m"), F.lit(1e-12))))
        pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))] if full else []
        gradient = [F.sum((F.lit(1.0) - F.col("y") / F.greatest(F.col("m"), F.lit(1e-12))) * F.col(f"g{k}")) for k in range(len(features))] if full else []
        curve = [F.sum(F.col(f"g{i}") * F.col(f"g{j}") / F.greatest(F.col("m"), F.lit(1e-12))) for i, j in pairs]
        return [float(v or 0.0) for v in by_group.agg(loss, *gradient, *curve).first()], pairs

    for _ in range(rounds):
        values, pairs = pieces(beta, True)
        n = len(features)
        gradient, hessian = np.array(values[1 : n + 1]), np.zeros((n, n))
        for (i, j), v in zip(pairs, values[n + 1 :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + 1e-8 * np.eye(n), gradient)
        scale = 1.0
        while scale > 1e-4 and pieces(beta - scale * step, False)[0][0] > values[0]:
            scale /= 2
        if scale <= 1e-4:
            break
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return beta.tolist()


def standardised(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features with mean 0 and population deviation 1 (a constant one becomes 0)."""
    stats = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(F.broadcast(stats))
    out = out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in features})
    return out.select(*rows.columns)


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], target: str, base: str) -> DataFrame:
    """(scenario, r2, mae, rmse, corr, rmsle): one small fit for each set of features."""
    from hexcast.operators.evaluate import regression_metrics
    from hexcast.operators.risk import union_all

    out = []
    for name, features in groups.items():
        known = [f for f in features if f in train.columns]
        model = fit_delta(train, known, target, base, maxIter=10)
        scored = score_delta(model, test.where(F.col(target).isNotNull()), known, base, "pred")
        out.append(regression_metrics(scored.withColumn("scenario", F.lit(name)), ["scenario"], target, "pred", 4))
    return union_all(out)


def synthetic_world(spark, side: int = 15, cells: int = 6) -> DataFrame:
    """Districts of cells x cells on an integer grid with population, covariates and a hidden truth."""
    n = side * cells
    rows = spark.range(n * n).select((F.col("id") % n).alias("gx"), F.floor(F.col("id") / n).alias("gy"))
    rows = rows.withColumn("district", F.floor(F.col("gx") / cells) + side * F.floor(F.col("gy") / cells))
    noise = lambda k: F.pmod(F.xxhash64("gx", "gy", F.lit(k)), F.lit(10_000)) / 10_000.0
    rows = rows.withColumn("population", F.lit(200.0) - F.log(F.lit(1.0001) - noise(1)) * 800.0)
    rows = rows.withColumn("ndvi", F.sin(F.col("gx") / 9.0) + noise(2) * 0.4).withColumn("rainfall", F.cos(F.col("gy") / 11.0) + noise(3) * 0.4)
    return rows.withColumn("true_cases", F.col("population") * F.exp(F.lit(-6.0) + 0.8 * F.col("ndvi") + 0.5 * F.col("rainfall")))


def unscaled(rows: DataFrame, intercept: float, coefficients: dict[str, float]) -> DataFrame:
    """One row: intercept and coefficients on the covariates' own scale, from those of standardised covariates."""
    mean, sd = (lambda c: F.avg(c)), (lambda c: F.nullif(F.stddev_pop(c), F.lit(0.0)))
    shift = sum((F.lit(b) * mean(c) / sd(c) for c, b in coefficients.items()), F.lit(0.0))
    return rows.agg((F.lit(intercept) - shift).alias("intercept"), *[(F.lit(b) / sd(c)).alias(c) for c, b in coefficients.items()])


def save(model: PipelineModel, features: list[str], path: str) -> None:
    """Write a fitted model and, beside it, the list of its features in order."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(k, f) for k, f in enumerate(features)], "place int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    """The model and its features, as save() wrote them."""
    rows = spark.read.schema("place int, feature string").json(f"{path}/features").orderBy("place").collect()  # one row for each feature
    return PipelineModel.load(f"{path}/model"), [r["feature"] for r in rows]
