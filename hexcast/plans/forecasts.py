"""Registered queries of the leaf-wise booster at all four horizons."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcast.operators import boosting, evaluate, models
from hexcast.plans import queries as Q
from hexcast.plans.queries import KEYS, query

#: 10 trees for the blueprint's 250, so that runs on the small tables stay short; the rest of the shape is as there
TREES = 10


def horizon_rows(rows):
    """A row for each horizon from 1 to 4, with the change of cases as target."""
    change = [F.struct(F.lit(k).alias("horizon"), F.col(f"cases_lead_{k}").alias("actual"), (F.col(f"cases_lead_{k}") - F.col("cases_lag_1")).alias("change")) for k in (1, 2, 3, 4)]
    return rows.withColumn("h", F.explode(F.array(*change))).select("*", "h.*").drop("h")


def leafwise(spark, d):
    """Test rows of all horizons with the booster's prediction, fitted on the years before 1999."""
    rows = Q.training_panel(spark, d)
    features = models.feature_columns(rows)
    train, test = horizon_rows(rows.where("year < 1999")), horizon_rows(rows.where("year >= 1999"))
    model = boosting.fit(train, features, "change", "horizon", boosting.Shape(trees=TREES))
    scored = model.predict(test.where("actual is not null"), "horizon", "change_pred")
    return scored.withColumn("pred", F.greatest(F.lit(0.0), F.coalesce("cases_lag_1", F.lit(0.0)) + F.col("change_pred")))


@query()
def leafwise_scores(spark, d):
    """Predicted cases of every district and week one to four weeks ahead."""
    return leafwise(spark, d).select(*KEYS, "monday", "horizon", "actual", "pred")


@query()
def leafwise_gate(spark, d):
    """Scores of the booster at each horizon beside the seasonal mean's, and whether it passes."""
    tree = evaluate.regression_metrics(leafwise(spark, d), ["horizon"], "actual", "pred", 4).withColumnRenamed("r2", "tree_r2")
    base = Q.seasonal_baseline_metrics(spark, d).select("horizon", F.col("r2").alias("seasonal_r2"))
    return tree.join(base, "horizon", "left").withColumn("passes", F.col("tree_r2") > F.col("seasonal_r2"))
