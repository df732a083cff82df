"""Views of the tables that stand for the panel's inputs: cells, risks, weekly cases, weather, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcast.functions.exprs import exact_sum, iso_week, iso_year, mask_sentinels, week_index, week_start

GRID_COLUMNS = 40
PARENT_SIZE = 7
MISSING_RAIN = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, district, state) for each nation: 25 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("district"), F.col("r_name").alias("state"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axial hexagon cells: cell, q, r, district, state, centre."""
    q, r = F.col("cell") % GRID_COLUMNS, F.floor(F.col("cell") / GRID_COLUMNS)
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("key"))
    out = base.join(F.broadcast(places(spark, sf_dir)), "key").select("cell", q.alias("q"), r.alias("r"), "district", "state")
    lon = F.lit(68.0) + F.lit(0.03) * F.col("q") + F.lit(0.015) * (F.col("r") % 2)
    return out.withColumn("center_lon", lon).withColumn("center_lat", F.lit(8.0) + F.lit(0.03) * F.col("r"))


def risk_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, a): the first disease's predicted risk."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell")).agg((exact_sum("o_totalprice") / 100000).alias("a"))


def risk_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, b): the second disease's predicted risk; covers only some cells."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
    return rows.groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("b"))


def weekly_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, state, monday, cases): district weeks that have cases."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("key"))
    home = customer.join(F.broadcast(places(spark, sf_dir)), "key")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), week_start("o_orderdate").alias("monday"))
    return rows.join(home, "cell").groupBy("district", "state", "monday").agg(F.count(F.lit(1)).cast("double").alias("cases"))


def cell_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, disease, year, week, week_index, value) from the event stream's table."""
    events = table(spark, sf_dir, "events")
    monday = week_start("ts")
    out = events.select(F.col("user_id").alias("cell"), F.col("event_type").alias("disease"), monday.alias("monday"), "value")
    out = out.groupBy("cell", "disease", "monday").agg(F.sum("value").alias("value"))
    return out.select("cell", "disease", iso_year("monday").alias("year"), iso_week("monday").alias("week"), week_index("monday").alias("week_index"), "value")


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, state, date, rain, tmax, tmin) by supplier's place; rain has a sentinel for missing."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("key"))
    home = supplier.join(F.broadcast(places(spark, sf_dir)), "key")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_discount", "l_tax")
    rows = rows.join(home, "l_suppkey")
    rain = mask_sentinels("l_quantity", [MISSING_RAIN])
    return rows.select(
        "district", "state", "date", rain.alias("rain"), (F.lit(20.0) + F.lit(100.0) * F.col("l_discount")).alias("tmax"), (F.lit(10.0) + F.lit(100.0) * F.col("l_tax")).alias("tmin")
    )


def hotspot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actual, predicted, horizon, is_holdout): one row for each line and horizon 1 to 4."""
    rows = table(spark, sf_dir, "lineitem")
    horizon = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("horizon")
    out = rows.select((F.col("l_extendedprice") > 40000).alias("actual"), "l_quantity", (F.col("l_suppkey") % 100 < 15).alias("is_holdout"), horizon)
    return out.select("actual", (F.col("l_quantity") > 10 * F.col("horizon")).alias("predicted"), "horizon", "is_holdout")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prediction, actual, lower_90, upper_90, lower_95, upper_95)."""
    p = F.col("l_extendedprice")
    scaled = {"lower_90": 0.92, "upper_90": 0.99, "lower_95": 0.90, "upper_95": 1.0}
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(p.alias("prediction"), (p * (F.lit(1.0) - F.col("l_discount"))).alias("actual"), *[(p * F.lit(k)).alias(n) for n, k in scaled.items()])


def shap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, disease, feature, value): signed contributions in long form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("disease"), F.posexplode("embedding").alias("feature", "v"))
    return rows.select("cell", "disease", "feature", F.col("v").cast("double").alias("value"))
