"""Registered queries of the serving routes and display expressions, each beside its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hexcast.functions import exprs as X
from hexcast.operators import alerts, risk
from hexcast.plans.queries import CELLS, KEYS, PERCENT, RISK_A, WEATHER, query
from hexcast.session import shared_folder
from hexcast.sources import files
from hexcast.sources import tables as T

HORIZON = "h AS (SELECT o_custkey AS cell, CAST(o_orderkey % 4 + 1 AS INTEGER) AS horizon, round(sum(o_totalprice), 2) / 100000 AS v FROM orders GROUP BY 1, 2)"
GRID = f"""{CELLS}, {HORIZON}, top AS (SELECT horizon, coalesce(nullif(max(v), 0), 1.0) AS m FROM h GROUP BY 1),
grid AS (SELECT cell, district, state, center_lon, center_lat, g.horizon, coalesce(v, 0.0) AS v, m
  FROM (SELECT *, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS horizon FROM cells) g LEFT JOIN h USING (cell, horizon) JOIN top USING (horizon))"""


def horizons(spark, d):
    """A prediction for each cell and horizon: the orders' sums by horizon stand for them."""
    orders = T.table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("horizon"), "o_totalprice")
    return orders.groupBy("cell", "horizon").agg((F.round(F.sum("o_totalprice"), 2) / 100000).alias("v"))  # in cents: sums of doubles differ in their last bits


@query(f"WITH {GRID} SELECT cell, district, state, horizon, round(v, 7) AS risk, {PERCENT.format(v='v', m='m')} AS risk_percent FROM grid")
def risk_all(spark, d):
    rows = risk.at_all_horizons(T.cells(spark, d), horizons(spark, d), "v", list(risk.HORIZONS))
    # cents by 100,000 have seven decimals; at fewer, halves are rounded by how a double is read
    return rows.select("cell", "district", "state", "horizon", F.round("v", 7).alias("risk"), F.round("risk_percent", 4).alias("risk_percent"))


@query(f"WITH {GRID}, corner AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k), xy AS (SELECT k, CAST([0, -0.015, -0.015, 0, 0.015, 0.015, 0][k + 1] AS DOUBLE) AS x, CAST([0.02, 0.01, -0.01, -0.02, -0.01, 0.01, 0.02][k + 1] AS DOUBLE) AS y FROM corner) SELECT cell, horizon, string_agg(printf('%.4f %.4f', round(center_lon + x, 4), round(center_lat + y, 4)), ', ' ORDER BY k) AS ring, {PERCENT.format(v='v', m='m')} AS risk_percent FROM grid, xy GROUP BY cell, horizon, v, m")
def geojson_all(spark, d):
    """Closed rings of all cells at all horizons, as text."""
    rows = risk.at_all_horizons(T.cells(spark, d), horizons(spark, d), "v", list(risk.HORIZONS))
    point = lambda p: F.format_string("%.4f %.4f", F.round(p[0], 4), F.round(p[1], 4))
    ring = F.array_join(F.transform(X.closed_ring("center_lon", "center_lat"), point), ", ")
    return rows.select("cell", "horizon", ring.alias("ring"), F.round("risk_percent", 4).alias("risk_percent"))


@query(f"""WITH {GRID}, corner AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k), xy AS (SELECT k, CAST([0, -0.015, -0.015, 0, 0.015, 0.015, 0][k + 1] AS DOUBLE) AS x, CAST([0.02, 0.01, -0.01, -0.02, -0.01, 0.01, 0.02][k + 1] AS DOUBLE) AS y FROM corner), ring AS (SELECT cell, district, state, string_agg('[' || (center_lon + x) || ',' || (center_lat + y) || ']', ',' ORDER BY k) AS ring, {PERCENT.format(v='v', m='m')} AS p FROM grid, xy WHERE horizon = 1 GROUP BY cell, district, state, v, m)
SELECT cell, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || ring || ']]}},"properties":{{"cell":' || cell || ',"district":"' || district || '","state":"' || state || '","risk_percent":' || p || ',"is_aggregate":false}}}}' AS feature FROM ring""")
def geojson_polygons(spark, d):
    """GeoJSON polygon features of all cells at the first horizon."""
    rows = risk.at_all_horizons(T.cells(spark, d), horizons(spark, d), "v", [1])
    return risk.polygon_features(rows.withColumn("risk_percent", F.round("risk_percent", 4)), ["cell", "district", "state", "risk_percent"])


@query(f"WITH {CELLS}, {RISK_A}, p AS (SELECT state, a / (SELECT max(a) FROM risk_a) * 100 AS p FROM risk_a JOIN cells USING (cell)), s AS (SELECT state, count_if(p >= 75) AS high_alert, count_if(p >= 40 AND p < 75) AS warning FROM p GROUP BY 1) SELECT state, high_alert, warning FROM s WHERE high_alert > 0 OR warning > 0 ORDER BY high_alert DESC, warning DESC, state", high_alert="BIGINT", warning="BIGINT")
def priority_states(spark, d):
    """States with an alert or a warning, most alerts first."""
    rows = T.risk_a(spark, d).join(T.cells(spark, d), "cell")
    top = T.risk_a(spark, d).agg(F.max("a").alias("top"))
    rows = rows.join(F.broadcast(top)).withColumn("p", F.col("a") / F.col("top") * 100)  # one row
    return alerts.priority(rows.withColumn("band", X.percent_band("p")), "state", "band")


@query(f"WITH {CELLS} SELECT state, district, cell FROM cells ORDER BY state, district, cell LIMIT 250")
def first_cells(spark, d):
    return risk.first_rows(T.cells(spark, d).select("state", "district", "cell"), 250, "state", "district", "cell")


@query("WITH k AS (SELECT DISTINCT replace(p_name, ' ', '_') AS key FROM part), named AS (SELECT * FROM (VALUES ('red_widget', 'Scarlet'), ('blue_widget', 'Azure')) v(key, label)) SELECT key, coalesce(label, upper(split_part(key, '_', 1)[1]) || split_part(key, '_', 1)[2:]) AS label, replace(key, '_', ' ') AS description FROM k LEFT JOIN named USING (key)")
def feature_labels(spark, d):
    keys = T.table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("key")).distinct()
    named = spark.createDataFrame([("red_widget", "Scarlet"), ("blue_widget", "Azure")], "key string, label string")  # the dictionary
    out = keys.join(F.broadcast(named), "key", "left")
    return out.select("key", F.coalesce("label", X.label_of("key")).alias("label"), F.replace("key", F.lit("_"), F.lit(" ")).alias("description"))


@query(f"WITH {WEATHER} SELECT district, state, date, round(avg((tmax + tmin) / 2), 6) AS tmean, round(avg(tmax - tmin), 6) AS dtr FROM weather GROUP BY 1, 2, 3")
def temperature_features(spark, d):
    rows = T.weather_daily(spark, d).groupBy(*KEYS, "date")
    return rows.agg(F.round(F.avg(X.mean_temperature("tmax", "tmin")), 6).alias("tmean"), F.round(F.avg(X.daily_range("tmax", "tmin")), 6).alias("dtr"))


@query(f"WITH {CELLS}, p AS (SELECT cell, CAST(68 + q AS DOUBLE) AS lon, CAST(8 + r AS DOUBLE) AS lat FROM cells), b AS (SELECT *, (CASE WHEN lon > 85 THEN 100.0 ELSE 30.0 END)::DOUBLE + (CASE WHEN lat < 15 THEN 60.0 ELSE 10.0 END)::DOUBLE AS rain FROM p) SELECT cell, rain, round(least(1.0, greatest(0.0, (rain / 200 + (30 - abs(lat - 20)) / 30) / 2)), 6) AS suitability FROM b")
def climate_scores(spark, d):
    rows = T.cells(spark, d).select("cell", (F.col("q") + 68.0).alias("lon"), (F.col("r") + 8.0).alias("lat")).withColumn("rain", X.base_rain("lon", "lat"))
    return rows.select("cell", "rain", F.round(X.suitability("rain", "lat"), 6).alias("suitability"))


@query(f"WITH {RISK_A}, p AS (SELECT cell, round(greatest(0.001, a / (SELECT max(a) FROM risk_a)), 6) AS risk FROM risk_a), c AS (SELECT cell, risk, risk * 100 AS x FROM p) SELECT cell, risk, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'moderate' ELSE 'low' END AS band, CAST(round(CASE WHEN x < 25 THEN 59 + x * (34 - 59) / 25.0::DOUBLE WHEN x < 50 THEN 34 + (x - 25) * (249 - 34) / 25.0::DOUBLE WHEN x < 75 THEN 249 + (x - 50) * (239 - 249) / 25.0::DOUBLE WHEN x < 100 THEN 239 + (x - 75) * (153 - 239) / 25.0::DOUBLE ELSE 153 END) AS INTEGER) AS red FROM c")
def risk_bands(spark, d):
    rows = T.risk_a(spark, d)
    top = rows.agg(F.max("a").alias("top"))
    rows = rows.join(F.broadcast(top)).withColumn("risk", F.round(X.at_least(F.col("a") / F.col("top")), 6))  # one row
    return rows.select("cell", "risk", X.plan_band("risk").alias("band"), X.risk_colour(F.col("risk") * 100)["red"].alias("red"))


@query("WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2, avg(l_tax) AS m3, stddev_pop(l_tax) AS s3 FROM lineitem) SELECT round(2 - (0.5 * m1 / s1 + -0.25 * m2 / s2 + 0.1 * m3 / s3), 6) AS intercept, round(0.5 / s1, 6) AS l_quantity, round(-0.25 / s2, 6) AS l_discount, round(0.1 / s3, 6) AS l_tax FROM s")
def unscaled_coefficients(spark, d):
    """Coefficients of standardised covariates, on the covariates' own scale."""
    from hexcast.operators.models import unscaled

    out = unscaled(T.table(spark, d, "lineitem"), 2.0, {"l_quantity": 0.5, "l_discount": -0.25, "l_tax": 0.1})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# ---- files: written by the sinks, read back by the readers ----------------------------------------


@query("SELECT c_custkey AS cell, c_name AS name, round(c_acctbal, 2) AS balance FROM customer WHERE c_nationkey < 5")
def csv_files(spark, d):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(T.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    rows = files.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double").where("c_nationkey < 5")
    return rows.select(F.col("c_custkey").alias("cell"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))


@query("SELECT o_custkey AS cell, o_orderstatus AS disease, CAST(o_orderkey % 4 + 1 AS INTEGER) AS horizon, count(*) AS n FROM orders WHERE o_orderkey % 4 + 1 = 2 GROUP BY 1, 2, 3")
def feature_files(spark, d):
    """Gzip JSON lines by disease and horizon, under a folder of their week; one horizon's folders are read."""
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    rows = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell"), F.col("o_orderstatus").alias("disease"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("horizon"))
    files.write_features(rows.agg(F.count(F.lit(1)).alias("n")), path, 2024, 7)
    return spark.read.schema("cell long, n long, disease string, horizon int").json(f"{path}/{files.version(2024, 7)}").where("horizon = 2").select("cell", "disease", "horizon", "n")


@query("SELECT l_returnflag AS flag, l_orderkey AS cell, l_linenumber AS line, l_quantity AS value FROM lineitem WHERE l_returnflag = 'R'")
def partitioned_parquet(spark, d):
    """Parquet folders by flag, one of them read."""
    path = f"{shared_folder(spark)}/parquet-{uuid.uuid4().hex}"
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("flag"))
    files.write_parquet(rows, path, "flag")
    return spark.read.parquet(path).where("flag = 'R'").select("flag", "cell", "line", "value")


@query("WITH w AS (SELECT l_orderkey AS cell, count(*) AS days, round(max(CAST(20 AS DOUBLE) + CAST(100 AS DOUBLE) * l_discount), 6) AS warmest, sum(l_quantity) AS rain FROM lineitem GROUP BY 1) SELECT CAST(cell AS VARCHAR) AS h3_index, days, warmest, rain FROM w", rain="DOUBLE")
def weather_documents(spark, d):
    """Nested weather documents, one for each order (a few lines), written as JSON arrays and read by the documents' reader."""
    path = f"{shared_folder(spark)}/weather-{uuid.uuid4().hex}"
    day = F.struct("l_linenumber", (F.lit(20.0) + F.lit(100.0) * F.col("l_discount")).alias("tmax"), F.col("l_quantity").cast("double").alias("rain"))
    docs = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("h3_index")).agg(F.sort_array(F.collect_list(day)).alias("days"))
    daily = F.struct(F.col("days.tmax").alias("temperature_2m_max"), F.col("days.tmax").alias("temperature_2m_min"), F.col("days.rain").alias("precipitation_sum"))
    files.write_weather_docs(docs.select("h3_index", daily.alias("daily")), path)
    rows = files.read_weather_docs(spark, path)
    total = F.aggregate("daily.precipitation_sum", F.lit(0.0), lambda a, x: a + x)
    return rows.select("h3_index", F.size("daily.precipitation_sum").cast("long").alias("days"), F.round(F.array_max("daily.temperature_2m_max"), 6).alias("warmest"), total.alias("rain"))
