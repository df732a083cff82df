"""Registered queries of the risk engine, each beside its SQL oracle.

A query is a function of (spark, sf_dir); its oracle is SQL over the same tables. Sums of doubles are
rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.functions import exprs as X
from hexcast.operators import alerts, evaluate, explain, models, panel, risk, search, spatial, treeshap
from hexcast.session import materialised, shared_folder
from hexcast.sources import tables as T
from hexcast.streaming import weekly as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PRIORITY = ["AFRICA", "ASIA"]
BOX = (68.1, 8.05, 68.6, 8.4, 12000)

PLACES = "places AS (SELECT n_nationkey AS key, n_name AS district, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)"
CELLS = PLACES + """, cells AS (
  SELECT c_custkey AS cell, c_custkey % 40 AS q, c_custkey // 40 AS r, district, state,
    CAST(68.0 AS DOUBLE) + CAST(0.03 AS DOUBLE) * (c_custkey % 40) + CAST(0.015 AS DOUBLE) * ((c_custkey // 40) % 2) AS center_lon,
    CAST(8.0 AS DOUBLE) + CAST(0.03 AS DOUBLE) * (c_custkey // 40) AS center_lat
  FROM customer JOIN places ON key = c_nationkey)"""
RISK_A = "risk_a AS (SELECT o_custkey AS cell, sum(o_totalprice) / 100000 AS a FROM orders GROUP BY 1)"
RISK_B = "risk_b AS (SELECT o_custkey AS cell, CAST(count(*) AS DOUBLE) AS b FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' GROUP BY 1)"
WEEKS = PLACES + """, cases0 AS (
  SELECT district, state, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(count(*) AS DOUBLE) AS cases
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON key = c_nationkey GROUP BY 1, 2, 3
), span AS (SELECT min(monday) AS a, max(monday) AS b FROM cases0
), dense AS (
  SELECT g.district, g.state, g.monday, coalesce(c.cases, 0.0) AS cases FROM (
    SELECT district, state, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS monday
    FROM (SELECT DISTINCT district, state FROM cases0), span) g
  LEFT JOIN cases0 c USING (district, state, monday))"""
PANEL = """panel AS (
  SELECT user_id AS cell, event_type AS disease, isoyear(CAST(date_trunc('week', ts) AS DATE)) AS year, weekofyear(CAST(date_trunc('week', ts) AS DATE)) AS week,
    CAST(date_diff('day', DATE '1969-12-29', CAST(date_trunc('week', ts) AS DATE)) / 7 AS INTEGER) AS week_index, sum(value) AS value
  FROM events GROUP BY 1, 2, 3, 4, 5)"""
WEATHER = PLACES + """, weather AS (
  SELECT district, state, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS rain,
    CAST(20 AS DOUBLE) + CAST(100 AS DOUBLE) * l_discount AS tmax, CAST(10 AS DOUBLE) + CAST(100 AS DOUBLE) * l_tax AS tmin
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON key = s_nationkey)"""
PERCENT = "round(least(99.9, greatest(0.1, {v} / {m} * 99.9)), 4)"
FLAGS = """flags AS (
  SELECT l_extendedprice > 40000 AS actual, l_quantity > 10 * horizon AS predicted, horizon, l_suppkey % 100 < 15 AS is_holdout
  FROM lineitem, (SELECT unnest([1, 2, 3, 4]) AS horizon))"""
RATIO = "coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def query(sql: str | None = None, **casts: str) -> Callable[[Query], Query]:
    """Register a query; casts name the SQL types of oracle columns that are wider there."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql and casts:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in casts.items())}) FROM ({sql})"
        elif sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- risk surfaces -----------------------------------------------------------------------------


@query(f"WITH {CELLS}, {RISK_A}, m AS (SELECT coalesce(nullif(max(a), 0), 1.0) AS m FROM risk_a) SELECT cell, district, state, round(a, 4) AS risk, {PERCENT.format(v='a', m='m')} AS risk_percent FROM risk_a JOIN cells USING (cell), m ORDER BY a DESC, cell LIMIT 100")
def hotspots_topn(spark, d):
    rows = risk.with_percent(T.risk_a(spark, d), "a")
    top = risk.top_n(rows, "a", 100)  # before the join: only the winners need their place
    return top.join(T.cells(spark, d), "cell").select("cell", "district", "state", F.round("a", 4).alias("risk"), "risk_percent")


@query(f"WITH {PANEL} SELECT cell, disease, year, week, round(value, 4) AS value FROM panel WHERE (year, week) = (SELECT (year, week) FROM panel ORDER BY year DESC, week DESC LIMIT 1)".replace("(year, week) = (SELECT (year, week)", "year * 100 + week = (SELECT year * 100 + week"), year="INTEGER", week="INTEGER")
def latest_period(spark, d):
    return risk.latest_period(T.cell_panel(spark, d)).select("cell", "disease", "year", "week", F.round("value", 4).alias("value"))


@query(f"WITH {CELLS}, {RISK_B} SELECT cell, district, state, coalesce(b, 0.0) AS b FROM cells LEFT JOIN risk_b USING (cell)")
def risk_full_grid(spark, d):
    return risk.on_full_grid(T.cells(spark, d), T.risk_b(spark, d), "b").select("cell", "district", "state", "b")


@query(f"WITH {RISK_A} SELECT cell, round(a, 4) AS a FROM risk_a WHERE a > 10")
def near_zero_filter(spark, d):
    return risk.above(T.risk_a(spark, d), "a", 10).select("cell", F.round("a", 4).alias("a"))


SYNDEMIC = f"{RISK_A}, {RISK_B}, both_ AS (SELECT cell, a, b FROM risk_a JOIN risk_b USING (cell)), fused AS (SELECT cell, a, b, sqrt(a / ma * (b / mb)) * 10.0 AS syndemic FROM both_, (SELECT coalesce(nullif(max(a), 0), 1.0) AS ma, coalesce(nullif(max(b), 0), 1.0) AS mb FROM both_))"


@query(f"WITH {CELLS}, {SYNDEMIC} SELECT cell, district, state, round(syndemic, 4) AS syndemic, {PERCENT.format(v='syndemic', m='(SELECT max(syndemic) FROM fused)')} AS risk_percent FROM fused JOIN cells USING (cell) ORDER BY fused.syndemic DESC, cell LIMIT 50")
def syndemic_hotspots(spark, d):
    fused = risk.with_percent(risk.syndemic(T.risk_a(spark, d), T.risk_b(spark, d)), "syndemic")
    top = risk.top_n(fused, "syndemic", 50).join(T.cells(spark, d), "cell")
    return top.select("cell", "district", "state", F.round("syndemic", 4).alias("syndemic"), "risk_percent")


HISTORY = f"{PANEL}, h AS (SELECT disease, year, week, avg(value) AS v FROM panel GROUP BY 1, 2, 3)"


@query(f"WITH {HISTORY} SELECT a.year, a.week, round(a.v, 6) AS a, round(b.v, 6) AS b, round(sqrt(a.v * b.v) * 10.0, 4) AS syndemic FROM h a JOIN h b ON a.year = b.year AND a.week = b.week WHERE a.disease = 'click' AND b.disease = 'view'", year="INTEGER", week="INTEGER")
def syndemic_history(spark, d):
    rows = T.cell_panel(spark, d)
    a, b = (risk.history(rows.where(F.col("disease") == k), "value").withColumnRenamed("value", n) for k, n in (("click", "a"), ("view", "b")))
    out = risk.syndemic_history(a, b)
    return out.select("year", "week", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("syndemic", 4).alias("syndemic"))


@query(f"WITH {CELLS}, {RISK_A}, {RISK_B} SELECT cell, district, state, round(coalesce(a, 0.0), 4) AS a, coalesce(b, 0.0) AS b, round(sqrt(coalesce(a, 0.0) / 10.0 * (coalesce(b, 0.0) / 10.0)) * 10.0, 4) AS syndemic FROM cells LEFT JOIN risk_a USING (cell) LEFT JOIN risk_b USING (cell) WHERE cell = 7")
def cell_risk_point(spark, d):
    one = T.cells(spark, d).where("cell = 7")
    rows = risk.on_full_grid(risk.on_full_grid(one, T.risk_a(spark, d), "a"), T.risk_b(spark, d), "b")
    fused = X.syndemic_normalised("a", F.lit(10.0), "b", F.lit(10.0))
    return rows.select("cell", "district", "state", F.round("a", 4).alias("a"), "b", F.round(fused, 4).alias("syndemic"))


@query(f"WITH {FLAGS} SELECT split, count(*) AS n, count_if(predicted) AS hot FROM (SELECT predicted, unnest(['all', CASE WHEN is_holdout THEN 'holdout' ELSE 'seen' END]) AS split FROM flags) GROUP BY split", hot="BIGINT")
def hotspot_seen_holdout_split(spark, d):
    rows = evaluate.with_splits(T.hotspot_flags(spark, d), "is_holdout")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("predicted").alias("hot"))


OVERVIEW = f"""WITH {CELLS}, {RISK_A}, {RISK_B}, full_ AS (SELECT cells.*, q // 7 AS pq, r // 7 AS pr, coalesce(a, 0.0) AS a, coalesce(b, 0.0) AS b FROM cells LEFT JOIN risk_a USING (cell) LEFT JOIN risk_b USING (cell)),
modes AS (SELECT pq, pr, state FROM (SELECT pq, pr, state, row_number() OVER (PARTITION BY pq, pr ORDER BY count(*) DESC, state) AS k FROM full_ GROUP BY 1, 2, 3) WHERE k = 1),
g AS (SELECT pq, pr, count(*) AS cell_count, avg(center_lat) AS lat, avg(center_lon) AS lon, arg_min(district, cell) AS district,
  max(CASE WHEN full_.state = 'AFRICA' THEN full_.state END) AS s1, max(CASE WHEN full_.state = 'ASIA' THEN full_.state END) AS s2,
  avg(a) AS a_mean, max(a) AS a_max, avg(b) AS b_mean, max(b) AS b_max FROM full_ GROUP BY 1, 2)
SELECT pq, pr, cell_count, round(lat, 6) AS center_lat, round(lon, 6) AS center_lon, district, coalesce(s1, s2, modes.state) AS state, round(a_mean, 4) AS a_mean, round(a_max, 4) AS a_max,
  round(0.7 * a_mean + 0.3 * a_max, 4) AS a_hybrid, {PERCENT.format(v='(0.7 * a_mean + 0.3 * a_max)', m='(SELECT max(a) FROM full_)')} AS a_percent, round(b_mean, 4) AS b_mean, b_max
FROM g JOIN modes USING (pq, pr)"""


@query(OVERVIEW)
def overview_parent(spark, d):
    rows = risk.on_full_grid(risk.on_full_grid(T.cells(spark, d), T.risk_a(spark, d), "a"), T.risk_b(spark, d), "b")
    rows = rows.withColumn("pq", F.floor(F.col("q") / T.PARENT_SIZE)).withColumn("pr", F.floor(F.col("r") / T.PARENT_SIZE))
    out = risk.overview(rows, ["pq", "pr"], ["a", "b"], PRIORITY)
    four = [F.round(c, 4).alias(c) for c in ("a_mean", "a_max", "a_hybrid", "b_mean")]
    return out.select("pq", "pr", "cell_count", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"), "district", "state", *four, "a_percent", "b_max")


def _viewport_sql(where: str) -> str:
    west, south, east, north, limit = BOX
    return f"""WITH {CELLS}, {RISK_A} SELECT cell, district, state, round(a, 4) AS risk, {PERCENT.format(v='a', m='(SELECT coalesce(nullif(max(a), 0), 1.0) FROM risk_a)')} AS risk_percent
FROM cells JOIN risk_a USING (cell) WHERE center_lon + 0.016 >= {west} AND center_lon - 0.016 <= {east} AND center_lat + 0.016 >= {south} AND center_lat - 0.016 <= {north} AND a > 0 {where} ORDER BY cell LIMIT {limit}"""


def _viewport(spark, d, state=None):
    a = T.risk_a(spark, d)
    largest = a.agg(X.positive_max("a").alias("largest"))
    rows = T.cells(spark, d).join(a, "cell").join(F.broadcast(largest))
    out = risk.viewport(rows, "a", BOX, F.col("largest"), state)
    return out.select("cell", "district", "state", F.round("a", 4).alias("risk"), "risk_percent")


@query(_viewport_sql(""))
def viewport_cells(spark, d):
    return _viewport(spark, d)


@query(_viewport_sql("AND state = 'ASIA'"))
def viewport_cells_state(spark, d):
    return _viewport(spark, d, "ASIA")


@query(f"WITH {CELLS}, {RISK_A} SELECT district, state, cell, round(a, 4) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY district, state ORDER BY a DESC, cell) AS k FROM cells JOIN risk_a USING (cell)) WHERE k = 1")
def district_top_cell(spark, d):
    rows = T.cells(spark, d).join(T.risk_a(spark, d), "cell").select("district", "state", "cell", "a")
    return risk.top_of_group(rows, ["district", "state"], "a").select("district", "state", "cell", F.round("a", 4).alias("risk"))


@query(f"WITH {CELLS}, {RISK_A}, {RISK_B} SELECT measure, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'a' AS measure, a AS value FROM risk_a UNION ALL SELECT 'b', b FROM risk_b) GROUP BY 1")
def union_long_form(spark, d):
    frames = [T.risk_a(spark, d).select(F.lit("a").alias("measure"), F.col("a").alias("value")), T.risk_b(spark, d).select(F.lit("b").alias("measure"), F.col("b").alias("value"))]
    return risk.union_all(frames).groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {CELLS}, {RISK_A}, {RISK_B} SELECT risk_state, count(*) AS n FROM (SELECT CASE WHEN a >= 15 THEN 'High' ELSE 'Low' END || '-' || CASE WHEN coalesce(b, 0.0) >= 1 THEN 'High' ELSE 'Low' END AS risk_state FROM risk_a LEFT JOIN risk_b USING (cell)) GROUP BY 1")
def combined_state(spark, d):
    rows = risk.on_full_grid(T.risk_a(spark, d), T.risk_b(spark, d), "b")
    return rows.groupBy(X.hot_cold_state("a", "b", 15, 1).alias("risk_state")).agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates --------------------------------------------------------------------------------

EXTENT = "round(avg(center_lat), 5) AS center_lat, round(avg(center_lon), 5) AS center_lon, round(min(center_lon), 5) AS min_lon, round(min(center_lat), 5) AS min_lat, round(max(center_lon), 5) AS max_lon, round(max(center_lat), 5) AS max_lat"
DISTRICTS = f"SELECT district, state, {EXTENT}, count(*) AS cell_count FROM cells GROUP BY 1, 2"
STATES = f"SELECT state, {EXTENT}, count(DISTINCT district) AS district_count, count(*) AS cell_count FROM cells GROUP BY 1"


@query(f"WITH {CELLS} {DISTRICTS}")
def district_places(spark, d):
    return search.district_index(T.cells(spark, d))


@query(f"WITH {CELLS} {STATES}")
def state_places(spark, d):
    return search.state_index(T.cells(spark, d))


@query(f"WITH {CELLS} SELECT count(*) AS cells, count(DISTINCT district) AS districts, count(DISTINCT state) AS states, count(*) * 8 AS forecasts FROM cells")
def analytics_kpi(spark, d):
    n = F.count(F.lit(1))
    return T.cells(spark, d).agg(n.alias("cells"), F.countDistinct("district").alias("districts"), F.countDistinct("state").alias("states"), (n * 8).alias("forecasts"))


@query(f"WITH {WEEKS} SELECT district, state, weekofyear(monday) AS week, round(avg(cases), 6) AS mean_cases FROM dense GROUP BY 1, 2, 3", week="INTEGER")
def seasonal_mean(spark, d):
    rows = dense_cases(spark, d).groupBy("district", "state", X.iso_week("monday").alias("week"))
    return rows.agg(F.round(F.avg("cases"), 6).alias("mean_cases"))


@query(f"WITH {WEEKS} SELECT state, isoyear(monday) AS year, weekofyear(monday) AS week, sum(cases) AS cases, round(avg(cases), 6) AS mean_cases FROM dense GROUP BY 1, 2, 3", year="INTEGER", week="INTEGER")
def district_coarse(spark, d):
    rows = dense_cases(spark, d).groupBy("state", X.iso_year("monday").alias("year"), X.iso_week("monday").alias("week"))
    return rows.agg(F.sum("cases").alias("cases"), F.round(F.avg("cases"), 6).alias("mean_cases"))


WEEKLY = "SELECT district, state, CAST(date_trunc('week', date) AS DATE) AS monday, coalesce(sum(rain), 0.0) AS rain, round(avg(tmax), 6) AS tmax, round(avg(tmin), 6) AS tmin FROM weather GROUP BY 1, 2, 3"


@query(f"WITH {WEATHER} {WEEKLY}")
def weekly_weather(spark, d):
    out = panel.weekly_weather(T.weather_daily(spark, d), ["district", "state"])
    return out.select("district", "state", "monday", "rain", F.round("tmax", 6).alias("tmax"), F.round("tmin", 6).alias("tmin"))


@query(f"WITH {WEATHER}, w AS ({WEEKLY}), {WEEKS.removeprefix(PLACES + ', ')} SELECT district, state, monday, cases, coalesce(rain, 0.0) AS rain, tmax FROM dense LEFT JOIN w USING (district, state, monday)")
def weekly_weather_left(spark, d):
    weather = panel.weekly_weather(T.weather_daily(spark, d), ["district", "state"])
    out = dense_cases(spark, d).join(weather, ["district", "state", "monday"], "left")
    return out.select("district", "state", "monday", "cases", F.coalesce("rain", F.lit(0.0)).alias("rain"), F.round("tmax", 6).alias("tmax"))


@query(f"WITH {WEATHER} SELECT r.district, r.state, r.date, r.rain, round(t.tmax, 6) AS tmax, round(u.tmin, 6) AS tmin FROM (SELECT district, state, date, sum(rain) AS rain FROM weather GROUP BY 1, 2, 3) r JOIN (SELECT district, state, date, avg(tmax) AS tmax FROM weather WHERE tmax > 22 GROUP BY 1, 2, 3) t USING (district, state, date) JOIN (SELECT district, state, date, avg(tmin) AS tmin FROM weather WHERE tmin > 12 GROUP BY 1, 2, 3) u USING (district, state, date)")
def weather_three_way(spark, d):
    # the three sides have one key: one conditional aggregation gives the rows that all three have
    high, low = F.when(F.col("tmax") > 22, F.col("tmax")), F.when(F.col("tmin") > 12, F.col("tmin"))
    rows = T.weather_daily(spark, d).groupBy("district", "state", "date")
    out = rows.agg(F.sum("rain").alias("rain"), F.round(F.avg(high), 6).alias("tmax"), F.round(F.avg(low), 6).alias("tmin"))
    return out.where("tmax is not null and tmin is not null")


@query(f"WITH {WEATHER} SELECT district, state, date, round(avg(tmax), 6) AS tmax, count(rain) AS valid, round(avg(rain), 6) AS rain FROM weather GROUP BY 1, 2, 3")
def zonal_mean(spark, d):
    rows = T.weather_daily(spark, d).groupBy("district", "state", "date")
    return rows.agg(F.round(F.avg("tmax"), 6).alias("tmax"), F.count("rain").alias("valid"), F.round(F.avg("rain"), 6).alias("rain"))


@query(f"WITH {CELLS}, s AS (SELECT district, count(*) AS n FROM cells GROUP BY 1) SELECT min(n) AS smallest_n, quantile_cont(n, 0.5) AS median_n, max(n) AS largest_n, (SELECT district FROM s ORDER BY n DESC, district LIMIT 1) AS largest, (SELECT district FROM s ORDER BY n, district LIMIT 1) AS smallest FROM s")
def group_size_extremes(spark, d):
    return evaluate.group_extremes(T.cells(spark, d), "district")


@query("SELECT DISTINCT event_type AS disease FROM events ORDER BY 1")
def sorted_distinct(spark, d):
    return T.table(spark, d, "events").select(F.col("event_type").alias("disease")).distinct().orderBy("disease")


# ---- panel -------------------------------------------------------------------------------------


def dense_cases(spark, d) -> DataFrame:
    return panel.dense_weeks(T.weekly_cases(spark, d), ["district", "state"], "cases")


KEYS = ["district", "state"]
OVER = "(PARTITION BY district, state ORDER BY monday"


@query(f"WITH {WEEKS} SELECT district, state, monday, cases, " + ", ".join(f"lag(cases, {k}) OVER {OVER}) AS cases_lag_{k}" for k in (1, 2, 3, 4, 8)) + " FROM dense")
def case_lags(spark, d):
    return panel.lags(dense_cases(spark, d), KEYS, "cases", [1, 2, 3, 4, 8])


@query(f"WITH {WEEKS} SELECT district, state, monday, cases, round(avg(cases) OVER {OVER} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS cases_roll_mean_4w, round(avg(cases) OVER {OVER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 6) AS cases_roll_mean_12w, round(stddev_samp(cases) OVER {OVER} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS cases_roll_std_4w, lag(cases, 1) OVER {OVER}) - lag(cases, 4) OVER {OVER}) AS cases_momentum_4w FROM dense")
def case_rolling(spark, d):
    out = panel.rolling_cases(dense_cases(spark, d), KEYS, "cases")
    return out.select(*KEYS, "monday", "cases", *[F.round(c, 6).alias(c) for c in ("cases_roll_mean_4w", "cases_roll_mean_12w", "cases_roll_std_4w")], "cases_momentum_4w")


@query(f"WITH {WEATHER}, w AS ({WEEKLY}), {WEEKS.removeprefix(PLACES + ', ')}, f AS (SELECT district, state, monday, coalesce(rain, 0.0) AS rain FROM dense LEFT JOIN w USING (district, state, monday)) SELECT district, state, monday, rain, lag(rain, 1) OVER {OVER}) AS rain_lag_1, lag(rain, 6) OVER {OVER}) AS rain_lag_6, sum(rain) OVER {OVER} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS rain_roll_sum_2w, sum(rain) OVER {OVER} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rain_roll_sum_4w FROM f")
def rain_rolling(spark, d):
    rows = weekly_weather_left(spark, d).select(*KEYS, "monday", "rain")
    return panel.rolling_sum(panel.lags(rows, KEYS, "rain", [1, 6]), KEYS, "rain", [2, 4])


@query(f"WITH {WEEKS} SELECT district, state, monday, cases, " + ", ".join(f"lead(cases, {k}) OVER {OVER}) AS cases_lead_{k}" for k in (1, 2, 3, 4)) + " FROM dense")
def lead_targets(spark, d):
    return panel.leads(dense_cases(spark, d), KEYS, "cases", [1, 2, 3, 4])


@query("SELECT CAST(o_orderdate AS DATE) AS day, isoyear(o_orderdate) AS iso_year, weekofyear(o_orderdate) AS week, round(sin(2.0 * pi() * weekofyear(o_orderdate) / 52.0), 6) + 0.0 AS sin_week, round(cos(2.0 * pi() * weekofyear(o_orderdate) / 52.0), 6) + 0.0 AS cos_week, count(*) AS n FROM orders GROUP BY ALL", iso_year="INTEGER", week="INTEGER")
def season_encoding(spark, d):
    rows = T.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    sin, cos = X.season("week")
    rows = rows.withColumn("week", X.iso_week("day"))
    return rows.select("day", X.iso_year("day").alias("iso_year"), "week", (F.round(sin, 6) + 0.0).alias("sin_week"), (F.round(cos, 6) + 0.0).alias("cos_week"), "n")


CENSUS = [2000, 2005, 2010, 2015, 2020]
POPULATION = " UNION ALL ".join(f"SELECT district, state, {y} AS year, CAST(1000 * (key + 1) + {(y - 2000) * (y - 2000)} AS DOUBLE) AS population FROM places" for y in CENSUS)


@query(f"WITH {PLACES}, c AS ({POPULATION}), n AS (SELECT *, lead(year) OVER w AS y1, lead(population) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY district, state ORDER BY year)) SELECT district, state, t AS year, round(CASE WHEN y1 IS NULL THEN population ELSE population + (p1 - population) * (t - year) / (y1 - year) END, 6) AS population FROM (SELECT *, CAST(unnest(generate_series(year, coalesce(y1 - 1, year))) AS INTEGER) AS t FROM n)")
def pop_interpolation(spark, d):
    year = F.explode(F.array(*[F.lit(y) for y in CENSUS])).alias("year")
    points = T.places(spark, d).select("district", "state", "key", year)
    points = points.withColumn("population", (1000 * (F.col("key") + 1) + (F.col("year") - 2000) * (F.col("year") - 2000)).cast("double"))
    out = panel.interpolate(points, KEYS, "year", "population")
    return out.select(*KEYS, "year", F.round("population", 6).alias("population"))


@query(f"WITH {CELLS}, {RISK_A}, t AS (SELECT district, state, cell, a, sum(a) OVER (PARTITION BY district, state) AS s, CAST(count(*) OVER (PARTITION BY district, state) AS DOUBLE) AS n FROM cells JOIN risk_a USING (cell)) SELECT district, state, cell, round(a / s * (n * 100.0), 6) AS share FROM t")
def mass_preserving(spark, d):
    rows = T.cells(spark, d).join(T.risk_a(spark, d), "cell").select("district", "state", "cell", "a")
    totals = rows.groupBy(*KEYS).agg((F.count(F.lit(1)).cast("double") * 100.0).alias("total"))
    out = panel.mass_preserving(rows.join(totals, KEYS), KEYS, "a", "total")
    return out.select(*KEYS, "cell", F.round("share", 6).alias("share"))


@query(f"WITH {PANEL} SELECT * FROM (SELECT year, week, round(avg(value), 6) AS value FROM panel WHERE disease = 'click' GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 12) ORDER BY 1, 2", year="INTEGER", week="INTEGER")
def history_last12(spark, d):
    return risk.history(T.cell_panel(spark, d).where("disease = 'click'"), "value").select("year", "week", F.round("value", 6).alias("value"))


@query(f"WITH {WEEKS} SELECT fold, part, count(*) AS n, sum(cases) AS cases FROM (SELECT fold, CASE WHEN isoyear(monday) <= fold THEN 'train' ELSE 'validate' END AS part, cases FROM dense, (SELECT unnest([1996, 1997, 1998]) AS fold) WHERE isoyear(monday) <= fold + 1) GROUP BY 1, 2")
def expanding_folds(spark, d):
    rows = dense_cases(spark, d).withColumn("year", X.iso_year("monday"))
    return panel.expanding_folds(rows, [1996, 1997, 1998]).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("cases").alias("cases"))


@query(f"WITH {WEEKS} SELECT split, count(*) AS n FROM (SELECT CASE WHEN isoyear(monday) <= 1998 THEN 'train' WHEN isoyear(monday) <= 1999 THEN 'validation' ELSE 'test' END AS split FROM dense) GROUP BY 1")
def temporal_split(spark, d):
    rows = dense_cases(spark, d).select(panel.split_of(X.iso_year("monday"), 1998, 1999).alias("split"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---- spatial -----------------------------------------------------------------------------------


def _offsets_sql(values) -> str:
    return "(SELECT unnest([" + ", ".join(f"{{'dq': {q}, 'dr': {r}}}" for q, r in values) + "], recursive := true))"


def _ring_sql(k: int) -> str:
    return f"""WITH {CELLS}, {RISK_A}, v AS (SELECT cell, q, r, coalesce(a, 0.0) AS a FROM cells LEFT JOIN risk_a USING (cell)), o AS {_offsets_sql(spatial.ring(k))}
SELECT x.cell, round(avg(y.a), 9) AS ring_mean, count(y.cell) AS neighbours FROM (SELECT * FROM v, o) x LEFT JOIN v y ON y.q = x.q + x.dq AND y.r = x.r + x.dr GROUP BY 1"""


def _ring(spark, d, k):
    rows = risk.on_full_grid(T.cells(spark, d), T.risk_a(spark, d), "a").select("cell", "q", "r", "a")
    return spatial.ring_mean(rows, "a", k, "m").select("cell", F.round("m", 9).alias("ring_mean"), "neighbours")


@query(_ring_sql(1))
def kring_mean_1(spark, d):
    return _ring(spark, d, 1)


@query(_ring_sql(2))
def kring_mean_2(spark, d):
    return _ring(spark, d, 2)


GI = f"""{CELLS}, {RISK_A}, v AS (SELECT cell, q, r, round(coalesce(a, 0.0), 4) AS a FROM cells LEFT JOIN risk_a USING (cell)), o AS {_offsets_sql([(0, 0), *spatial.RING_1])},
s AS (SELECT x.cell, sum(y.a) AS s, CAST(count(*) AS DOUBLE) AS k FROM (SELECT * FROM v, o) x JOIN v y ON y.q = x.q + x.dq AND y.r = x.r + x.dr GROUP BY 1),
w AS (SELECT avg(a) AS m, stddev_pop(a) AS sd, CAST(count(*) AS DOUBLE) AS n FROM v), gi AS (SELECT cell, (s - m * k) / (sd * sqrt((n * k - k * k) / (n - 1.0))) AS z FROM s, w)"""


def gi_scores(spark, d) -> DataFrame:
    rows = risk.on_full_grid(T.cells(spark, d), T.risk_a(spark, d), "a").select("cell", "q", "r", F.round("a", 4).alias("a"))
    return spatial.gi_star(rows, "a")


@query(f"WITH {GI} SELECT cell, round(z, 6) AS z FROM gi")
def gi_star(spark, d):
    return gi_scores(spark, d).select("cell", F.round("z", 6).alias("z"))


@query(f"WITH {GI} SELECT class, count(*) AS n FROM (SELECT CASE WHEN z >= 2.58 THEN 'hot 99' WHEN z >= 1.96 THEN 'hot 95' WHEN z >= 1.65 THEN 'hot 90' WHEN z <= -2.58 THEN 'cold 99' WHEN z <= -1.96 THEN 'cold 95' WHEN z <= -1.65 THEN 'cold 90' ELSE 'not significant' END AS class FROM gi) GROUP BY 1")
def gi_class(spark, d):
    return gi_scores(spark, d).groupBy(X.gi_class("z").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GI} SELECT count(*) AS cells, count_if(z > 1.96) AS hotspots, count_if(z >= 1.96 AND z < 2.58) AS hot_95, count_if(z >= 2.58) AS hot_99 FROM gi", hotspots="BIGINT", hot_95="BIGINT", hot_99="BIGINT")
def hotspot_kpi(spark, d):
    z = F.col("z")
    return gi_scores(spark, d).agg(F.count(F.lit(1)).alias("cells"), F.count_if(z > 1.96).alias("hotspots"), F.count_if((z >= 1.96) & (z < 2.58)).alias("hot_95"), F.count_if(z >= 2.58).alias("hot_99"))


HEX = int("876036b21ffffff", 16)


@query(f"SELECT lower(to_hex((h & ~(15::BIGINT << 52)) | (4::BIGINT << 52) | ((1::BIGINT << 33) - 1))) AS parent, count(*) AS cells FROM (SELECT {HEX} + (c_custkey << 24) AS h FROM customer) GROUP BY 1")
def hex_parent_bits(spark, d):
    ids = T.table(spark, d, "customer").select((F.lit(HEX) + F.shiftleft("c_custkey", 24)).alias("h"))
    return ids.groupBy(X.hex_text(X.hex_parent("h", 4)).alias("parent")).agg(F.count(F.lit(1)).alias("cells"))


WARD_W, WARD_H = 0.24, 0.21


@query(f"WITH {CELLS} SELECT cell, CAST(wx * 100 + wy AS BIGINT) AS ward_id FROM (SELECT cell, floor((center_lon - 67.995) / {WARD_W}) AS wx, floor((center_lat - 7.995) / {WARD_H}) AS wy, center_lon, center_lat FROM cells) WHERE wx BETWEEN 0 AND 3 AND wy BETWEEN 0 AND 2 AND NOT (wx = 1 AND wy = 1 AND center_lon > 67.995 + {WARD_W} * 1.25 AND center_lon < 67.995 + {WARD_W} * 1.75 AND center_lat > 7.995 + {WARD_H} * 1.25 AND center_lat < 7.995 + {WARD_H} * 1.75)")
def point_in_polygon(spark, d):
    return spatial.points_in_polygons(T.cells(spark, d).select("cell", "center_lon", "center_lat"), wards(spark), ["ward_id"]).select("cell", "ward_id")


def wards(spark) -> DataFrame:
    """Twelve generated rectangles, one with a hole."""
    def box(x0, y0, x1, y1):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return [(67.995 + WARD_W * x, 7.995 + WARD_H * y) for x, y in corners]

    rows = []
    for x in range(4):
        for y in range(3):
            rings = [box(x, y, x + 1, y + 1)] + ([box(x + 0.25, y + 0.25, x + 0.75, y + 0.75)] if (x, y) == (1, 1) else [])
            rows.append((x * 100 + y, rings))
    return spark.createDataFrame(rows, "ward_id long, rings array<array<struct<lon: double, lat: double>>>")


@query(f"WITH {CELLS} SELECT ward_id, count(*) AS pixels, round(sum(center_lat), 4) AS total FROM (SELECT CAST(floor((center_lon - 67.995) / {WARD_W}) * 100 + floor((center_lat - 7.995) / {WARD_H}) AS BIGINT) AS ward_id, floor((center_lon - 67.995) / {WARD_W}) AS wx, floor((center_lat - 7.995) / {WARD_H}) AS wy, * FROM cells) WHERE wx BETWEEN 0 AND 3 AND wy BETWEEN 0 AND 2 AND NOT (wx = 1 AND wy = 1 AND center_lon > 67.995 + {WARD_W} * 1.25 AND center_lon < 67.995 + {WARD_W} * 1.75 AND center_lat > 7.995 + {WARD_H} * 1.25 AND center_lat < 7.995 + {WARD_H} * 1.75) GROUP BY 1")
def zonal_sum(spark, d):
    pixels = T.cells(spark, d).select("center_lon", "center_lat")
    out = spatial.points_in_polygons(pixels, wards(spark), ["ward_id"])
    return out.groupBy("ward_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum("center_lat"), 4).alias("total"))


@query(f"WITH {CELLS}, c AS (SELECT district AS place, avg(center_lon) AS x, avg(center_lat) AS y FROM cells GROUP BY 1), n AS (SELECT cell, place, row_number() OVER (PARTITION BY cell ORDER BY round((center_lon - x) * (center_lon - x) + (center_lat - y) * (center_lat - y), 12), place) AS k FROM cells, c) SELECT cell, place FROM n WHERE k = 1")
def nearest_centroid(spark, d):
    rows = T.cells(spark, d)
    centres = rows.groupBy(F.col("district").alias("place")).agg(F.avg("center_lon").alias("center_lon"), F.avg("center_lat").alias("center_lat"))
    return spatial.nearest(rows, centres, "cell", "place").select("cell", "place")


@query(f"WITH {CELLS}, {RISK_B} SELECT district, state FROM places ANTI JOIN (SELECT district, state FROM cells JOIN risk_b USING (cell) WHERE b >= 4) c USING (district, state)")
def districts_without_cell(spark, d):
    """Districts without a cell of risk 4 or more."""
    some = T.cells(spark, d).join(T.risk_b(spark, d).where("b >= 4"), "cell")
    return spatial.without_match(T.places(spark, d).select("district", "state"), some, KEYS)


@query(f"WITH {CELLS} SELECT cell FROM cells SEMI JOIN (SELECT o_custkey AS cell FROM orders WHERE o_orderstatus = 'F') x USING (cell)")
def membership_filter(spark, d):
    active = T.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("cell"))
    return T.cells(spark, d).join(active, "cell", "left_semi").select("cell")


# ---- evaluation --------------------------------------------------------------------------------


def _scores_sql(keys: str, source: str) -> str:
    r = lambda a, b: f"round({RATIO.format(a=a, b=b)}, 4)"
    return f"""SELECT {keys}, tp, fp, fn, tn, {r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1, {r('tp', 'tp + fp + fn')} AS iou
FROM (SELECT {keys}, count_if(actual AND predicted) AS tp, count_if(NOT actual AND predicted) AS fp, count_if(actual AND NOT predicted) AS fn, count_if(NOT actual AND NOT predicted) AS tn FROM {source} GROUP BY ALL)"""


@query(f"WITH {FLAGS} " + _scores_sql("horizon, split", "(SELECT actual, predicted, horizon, unnest(['all', CASE WHEN is_holdout THEN 'holdout' ELSE 'seen' END]) AS split FROM flags)"), tp="BIGINT", fp="BIGINT", fn="BIGINT", tn="BIGINT")
def hotspot_confusion(spark, d):
    return evaluate.confusion(evaluate.with_splits(T.hotspot_flags(spark, d), "is_holdout"), ["horizon", "split"], "actual", "predicted")


LEADS = f"{FLAGS}, rates AS (SELECT horizon, actual_n, detected_n, round({RATIO.format(a='detected_n', b='actual_n')}, 4) AS rate FROM (SELECT horizon, count_if(actual) AS actual_n, count_if(actual AND predicted) AS detected_n FROM flags GROUP BY 1))"


@query(f"WITH {LEADS} SELECT * FROM rates", actual_n="BIGINT", detected_n="BIGINT")
def lead_time_detection(spark, d):
    return evaluate.detection_rates(T.hotspot_flags(spark, d), "actual", "predicted", "horizon")


@query(f"WITH {LEADS} SELECT coalesce(max(CASE WHEN rate >= 0.5 THEN horizon END), 0) AS max_lead FROM rates")
def max_effective_lead(spark, d):
    return evaluate.max_effective_lead(lead_time_detection(spark, d), "horizon")


def _regression_sql(y: str, p: str) -> str:
    p = f"greatest(0.0, {p})"
    return f"round(1.0 - avg(({y} - {p}) * ({y} - {p})) / nullif(var_pop({y}), 0), 6) AS r2, round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse, round(CASE WHEN stddev_pop({p}) > 1e-9 THEN corr({y}, {p}) ELSE 0.0 END, 6) AS corr, round(sqrt(avg((ln(1 + greatest(0.0, {y})) - ln(1 + {p})) * (ln(1 + greatest(0.0, {y})) - ln(1 + {p})))), 6) AS rmsle"


@query(f"SELECT l_returnflag AS split, {_regression_sql('l_quantity', 'l_quantity * (1 - l_discount) - 3 * l_tax * l_linenumber')} FROM lineitem GROUP BY 1")
def regression_metrics(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("split"), "l_quantity", (F.col("l_quantity") * (1 - F.col("l_discount")) - 3 * F.col("l_tax") * F.col("l_linenumber")).alias("p"))
    return evaluate.regression_metrics(rows, ["split"], "l_quantity", "p")


INTERVALS = "intervals AS (SELECT l_extendedprice AS prediction, l_extendedprice * (1 - l_discount) AS actual, l_extendedprice * CAST(0.92 AS DOUBLE) AS lower_90, l_extendedprice * CAST(0.99 AS DOUBLE) AS upper_90, l_extendedprice * CAST(0.9 AS DOUBLE) AS lower_95, l_extendedprice * CAST(1.0 AS DOUBLE) AS upper_95 FROM lineitem)"


@query(f"WITH {INTERVALS} SELECT round(avg(CASE WHEN actual BETWEEN lower_90 AND upper_90 THEN 1.0 ELSE 0.0 END), 6) AS coverage_90, round(avg(CASE WHEN actual BETWEEN lower_95 AND upper_95 THEN 1.0 ELSE 0.0 END), 6) AS coverage_95, round(avg(abs(prediction - actual)), 4) AS mae FROM intervals")
def interval_coverage(spark, d):
    out = evaluate.interval_coverage(T.intervals(spark, d), [90, 95])
    return out.select(F.round("coverage_90", 6).alias("coverage_90"), F.round("coverage_95", 6).alias("coverage_95"), F.round("mae", 4).alias("mae"))


@query(f"WITH {INTERVALS} SELECT round(avg(w), 4) AS mean, " + ", ".join(f"round(quantile_cont(w, {q}), 4) AS {n}" for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))) + " FROM (SELECT upper_90 - lower_90 AS w FROM intervals)")
def interval_quantiles(spark, d):
    out = evaluate.width_quantiles(T.intervals(spark, d), "lower_90", "upper_90")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("SELECT o_orderpriority AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 2) AS percent FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_counts_pct(spark, d):
    return evaluate.value_counts(T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")), "label")


@query("WITH x AS (SELECT o_custkey AS k, sum(o_totalprice) AS a, CAST(count(*) AS DOUBLE) AS b FROM orders GROUP BY 1), n AS (SELECT greatest(1, CAST(floor(CAST(0.1 AS DOUBLE) * count(*)) AS BIGINT)) AS n FROM x), ra AS (SELECT k, row_number() OVER (ORDER BY a DESC, k) AS p FROM x), rb AS (SELECT k, row_number() OVER (ORDER BY b DESC, k) AS p FROM x) SELECT count(*) AS common, max(n) AS size, round(count(*) / CAST(max(n) AS DOUBLE), 4) AS overlap FROM ra JOIN rb USING (k), n WHERE ra.p <= n AND rb.p <= n")
def top_decile_overlap(spark, d):
    rows = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return evaluate.top_share_overlap(rows, "a", "b", "k")


@query("WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r")
def spearman_pearson(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    out = evaluate.spearman(rows, "a", "b")
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


# ---- profiles ----------------------------------------------------------------------------------

PROFILED = ["l_quantity", "l_discount", "rain"]
PROFILE_SRC = "(SELECT l_quantity, l_discount, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS rain FROM lineitem)"


def _profiled(spark, d):
    return T.table(spark, d, "lineitem").select("l_quantity", "l_discount", X.mask_sentinels("l_quantity", [50.0]).alias("rain"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percent, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM {PROFILE_SRC}" for c in PROFILED))
def column_profile(spark, d):
    out = evaluate.profile(_profiled(spark, d), PROFILED)
    return out.select("column", "n", "nulls", "null_percent", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM {PROFILE_SRC}" for c in PROFILED))
def describe_columns(spark, d):
    out = evaluate.describe(_profiled(spark, d), PROFILED)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"SELECT 'rain' AS \"column\", count(*) - count(rain) AS nulls, round(100.0::DOUBLE * (count(*) - count(rain)) / count(*), 2) AS null_percent FROM {PROFILE_SRC}")
def null_counts(spark, d):
    return evaluate.null_counts(_profiled(spark, d), PROFILED)


@query(" UNION ALL ".join(f"SELECT '{c}' AS target, round(avg({c}), 6) AS mean, max({c}) AS max, round(avg(CASE WHEN {c} > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 2) AS percent_positive FROM lineitem" for c in ("l_discount", "l_tax")))
def target_stats(spark, d):
    return evaluate.target_stats(T.table(spark, d, "lineitem"), ["l_discount", "l_tax"]).withColumn("mean", F.round("mean", 6))


@query("WITH c AS (SELECT quantile_cont(l_extendedprice, 0.95) AS cut FROM lineitem) SELECT round(max(cut), 4) AS cut, count_if(l_extendedprice > cut) AS above, count(*) AS n, round(count_if(l_extendedprice > cut) / CAST(count(*) AS DOUBLE), 6) AS share FROM lineitem, c", above="BIGINT")
def above_p95_share(spark, d):
    return evaluate.above_quantile(T.table(spark, d, "lineitem"), "l_extendedprice").withColumn("cut", F.round("cut", 4))


@query("SELECT round(quantile_cont(l_extendedprice, 0.995), 4) AS axis_limit FROM lineitem")
def axis_limit(spark, d):
    return evaluate.quantile(T.table(spark, d, "lineitem"), "l_extendedprice", 0.995, "axis_limit").select(F.round("axis_limit", 4).alias("axis_limit"))


@query(f"WITH {PANEL} SELECT count(DISTINCT cell) AS keys, count(DISTINCT year) AS years, count(DISTINCT year * 100 + week) AS periods, min(year) AS first_year, max(year) AS last_year, min(week) AS first_week, max(week) AS last_week FROM panel", first_week="INTEGER", last_week="INTEGER", first_year="INTEGER", last_year="INTEGER")
def temporal_coverage(spark, d):
    return evaluate.coverage(T.cell_panel(spark, d), "year", "week", "cell")


@query(f"WITH {PANEL} SELECT min(value) >= 0 AS non_negative, count_if(value IS NULL) AS missing FROM panel", missing="BIGINT")
def validity(spark, d):
    return T.cell_panel(spark, d).agg(F.bool_and(F.col("value") >= 0).alias("non_negative"), F.count_if(F.col("value").isNull()).alias("missing"))


# ---- alerts ------------------------------------------------------------------------------------

#: each customer's last two priced orders stand for predicted and current cases; z comes from Gi*
ALERTS = f"""{GI}, c AS (SELECT o_custkey AS cell, max(o_totalprice) AS predicted, min(o_totalprice) AS cur, CASE count(*) % 4 WHEN 0 THEN 'Persistent' WHEN 1 THEN 'Emerging' WHEN 2 THEN 'Intensifying' ELSE 'Diminishing' END AS taxonomy FROM orders GROUP BY 1),
al0 AS (SELECT cell, district, state, z, taxonomy, CASE WHEN cur < 1e-6 THEN 0.0 ELSE (predicted - cur) / cur * 100.0 END AS growth FROM c JOIN gi USING (cell) JOIN cells USING (cell)),
al AS (SELECT *, CASE WHEN z >= 2.58 AND taxonomy IN ('Persistent', 'Intensifying') THEN 3 WHEN z >= 1.96 AND taxonomy = 'Emerging' THEN 2 WHEN growth > 20 OR z > 1.65 THEN 1 ELSE 0 END AS alert_level FROM al0)"""


def alert_rows(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["Persistent", "Emerging", "Intensifying", "Diminishing"])), (F.count(F.lit(1)) % 4 + 1).cast("int"))
    cases = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.max("o_totalprice").alias("predicted"), F.min("o_totalprice").alias("current"), kind.alias("taxonomy"))
    rows = cases.join(gi_scores(spark, d), "cell").join(T.cells(spark, d), "cell")
    return alerts.with_alerts(rows, "predicted", "current", "z", "taxonomy")


@query(f"WITH {ALERTS} SELECT alert_level, count(*) AS n FROM al GROUP BY 1")
def alert_levels(spark, d):
    return alerts.level_counts(alert_rows(spark, d))


@query(f"WITH {ALERTS} SELECT state, " + ", ".join(f"count_if(alert_level = {k}) AS level_{k}" for k in range(4)) + " FROM al GROUP BY 1", level_0="BIGINT", level_1="BIGINT", level_2="BIGINT", level_3="BIGINT")
def alert_state_pivot(spark, d):
    return alerts.state_table(alert_rows(spark, d))


@query(f"WITH {ALERTS} SELECT count(*) AS cells, " + ", ".join(f"count_if(alert_level = {k}) AS level_{k}" for k in range(4)) + " FROM al", level_0="BIGINT", level_1="BIGINT", level_2="BIGINT", level_3="BIGINT")
def alert_summary(spark, d):
    return alerts.summary(alert_rows(spark, d))


@query(f"WITH {ALERTS} SELECT cell, district, alert_level, round(z, 6) AS z FROM al WHERE alert_level > 0 ORDER BY alert_level DESC, z DESC, cell LIMIT 20")
def top_alerts(spark, d):
    rows = alert_rows(spark, d).withColumn("z", F.round("z", 6))
    return alerts.strongest(rows, 20).select("cell", "district", "alert_level", "z")


@query(f"WITH {ALERTS} SELECT cell, district, state, alert_level FROM al WHERE state IN ('ASIA', 'AFRICA') AND alert_level >= 1")
def alert_table_filter(spark, d):
    return alert_rows(spark, d).where(F.col("state").isin("ASIA", "AFRICA") & (F.col("alert_level") >= 1)).select("cell", "district", "state", "alert_level")


@query(f"WITH {ALERTS} SELECT CAST(floor(growth / 4.0) + 1 AS BIGINT) AS bin, count(*) AS n FROM al WHERE growth < 200 GROUP BY 1")
def growth_histogram(spark, d):
    return alerts.growth_histogram(alert_rows(spark, d), 0.0, 200.0, 50)


RUNS = f"{PANEL}, hot AS (SELECT cell, disease, week_index FROM panel WHERE value > 20), isl AS (SELECT *, week_index - row_number() OVER (PARTITION BY cell, disease ORDER BY week_index) AS k FROM hot)"


@query(f"WITH {RUNS} SELECT cell, disease, min(week_index) AS first_week, max(week_index) AS last_week, count(*) AS weeks FROM isl GROUP BY cell, disease, k")
def persistence_runs(spark, d):
    return alerts.persistence_runs(T.cell_panel(spark, d).where("value > 20"), ["cell", "disease"])


TAXONOMY = f"""WITH {WEEKS}, s AS (SELECT district, state, (date_diff('day', DATE '1969-12-29', monday) // 7) AS t, (cases - avg(cases) OVER (PARTITION BY district, state)) / stddev_pop(cases) OVER (PARTITION BY district, state) AS z FROM dense),
l AS (SELECT *, coalesce(lag(z, 1) OVER w, 0.0) AS z1, coalesce(lag(z, 2) OVER w, 0.0) AS z2 FROM s WINDOW w AS (PARTITION BY district, state ORDER BY t)), last_ AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY district, state ORDER BY t DESC) = 1)
SELECT district, state, CASE WHEN z > 0.5 AND z1 > 0.5 AND z2 > 0.5 THEN 'Persistent' WHEN z > 0.5 AND z1 > 0.5 AND z > z1 THEN 'Intensifying' WHEN z > 0.5 THEN 'Emerging' WHEN z1 > 0.5 THEN 'Diminishing' ELSE 'Non-Hotspot' END AS taxonomy FROM last_"""


@query(TAXONOMY)
def taxonomy_labels(spark, d):
    rows = dense_cases(spark, d).withColumn("week_index", X.week_index("monday"))
    stats = rows.groupBy(*KEYS).agg(F.avg("cases").alias("m"), F.stddev_pop("cases").alias("sd"))
    rows = rows.join(stats, KEYS).withColumn("z", X.ratio(F.col("cases") - F.col("m"), "sd"))
    return alerts.taxonomy(rows, KEYS, hot=0.5).select(*KEYS, "taxonomy")


# ---- explanations ------------------------------------------------------------------------------

SHAP = "shap AS (SELECT vec_id AS cell, label AS disease, CAST(unnest(embedding) AS DOUBLE) AS value, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature FROM embeddings)"
GLOBAL = f"{SHAP}, imp AS (SELECT disease, feature, sum(abs(value)) / count(*) AS importance FROM shap GROUP BY 1, 2)"


@query(f"WITH {GLOBAL} SELECT disease, feature, round(importance, 6) AS importance, row_number() OVER (PARTITION BY disease ORDER BY importance DESC, feature) AS rank FROM imp")
def shap_global(spark, d):
    out = explain.global_importance(T.shap_rows(spark, d), ["disease"])
    return out.select("disease", "feature", F.round("importance", 6).alias("importance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SHAP} SELECT feature, value, abs(value) AS size FROM shap WHERE cell = 3 ORDER BY size DESC, feature LIMIT 15")
def shap_local_topk(spark, d):
    return explain.local_top(T.shap_rows(spark, d), 3)


MERGE = f"{GLOBAL}, mg AS (SELECT feature, sum(importance / 2) AS importance FROM imp WHERE disease IN (0, 1) GROUP BY 1)"


@query(f"WITH {MERGE} SELECT feature, round(importance, 6) AS importance FROM mg ORDER BY mg.importance DESC, feature LIMIT 15")
def shap_merge(spark, d):
    return _merged(spark, d).select("feature", F.round("importance", 6).alias("importance"))


def _merged(spark, d):
    out = explain.global_importance(T.shap_rows(spark, d).where("disease in (0, 1)"), ["disease"])
    return explain.merged(out.where("disease = 0"), out.where("disease = 1"))


@query(f"WITH {MERGE}, t AS (SELECT * FROM mg ORDER BY importance DESC, feature LIMIT 10) SELECT feature, round(importance, 6) AS importance, round(least(99.9, greatest(0.1, importance / (SELECT sum(importance) FROM t) * 100)), 4) AS impact, round(least(100.0, greatest(6.0, importance / (SELECT max(importance) FROM t) * 100)), 4) AS bar FROM t")
def shap_share(spark, d):
    return explain.shares(_merged(spark, d)).withColumn("importance", F.round("importance", 6))


# ---- search ------------------------------------------------------------------------------------


@query(f"WITH {CELLS}, x AS ({DISTRICTS}), s AS (SELECT *, CASE WHEN lower(district) = 'nation_1' THEN 100 WHEN starts_with(lower(district), 'nation_1') THEN 80 WHEN contains(' ' || lower(district), ' nation_1') THEN 70 WHEN contains(lower(district), 'nation_1') THEN 50 WHEN contains(lower(state), 'nation_1') THEN 30 ELSE 0 END AS score FROM x) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, cell_count DESC, district, state LIMIT 8")
def search_districts(spark, d):
    return search.search_districts(search.district_index(T.cells(spark, d)), " Nation_1 ", 8)


@query(f"WITH {CELLS}, x AS ({STATES}), s AS (SELECT *, CASE WHEN lower(state) = 'a' THEN 100 WHEN starts_with(lower(state), 'a') THEN 80 WHEN contains(lower(state), 'a') THEN 50 ELSE 0 END AS score FROM x) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, cell_count DESC, state LIMIT 4")
def search_states(spark, d):
    return search.search_states(search.state_index(T.cells(spark, d)), "A")


@query(f"SELECT hex, c_custkey AS cell FROM (SELECT c_custkey, lower(to_hex({HEX} + (c_custkey << 24))) AS hex FROM customer) WHERE starts_with(hex, '876036b2') ORDER BY hex LIMIT 5")
def search_cells_prefix(spark, d):
    rows = T.table(spark, d, "customer").select(X.hex_text(F.lit(HEX) + F.shiftleft("c_custkey", 24)).alias("hex"), F.col("c_custkey").alias("cell"))
    return search.search_cells(rows, "876036B2")


POPULAR = ["nation_3", "TION_1", "Nowhere", "nation_2"]


@query(f"WITH {CELLS}, x AS ({DISTRICTS}), w AS (SELECT unnest([0, 1, 2, 3]) AS position, unnest({POPULAR}) AS wanted), m AS (SELECT *, CASE WHEN lower(district) = lower(wanted) THEN 0 WHEN starts_with(lower(district), lower(wanted)) THEN 1 WHEN contains(lower(district), lower(wanted)) THEN 2 END AS kind FROM x, w) SELECT position, wanted, district, state, cell_count FROM m WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY position ORDER BY kind, cell_count DESC, district, state) = 1")
def popular_places(spark, d):
    return search.popular(search.district_index(T.cells(spark, d)), POPULAR)


# ---- documents and arrays ----------------------------------------------------------------------


@query(f"""WITH {CELLS}, {RISK_A} SELECT cell, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || center_lon || ',' || center_lat || ']}},"properties":{{"cell":' || cell || ',"district":"' || district || '","risk_percent":' || {PERCENT.format(v='a', m='(SELECT max(a) FROM risk_a)')} || '}}}}' AS feature FROM risk_a JOIN cells USING (cell)""")
def geojson_features(spark, d):
    rows = risk.with_percent(T.risk_a(spark, d), "a").join(T.cells(spark, d), "cell")
    return risk.features(rows.withColumn("risk_percent", F.round("risk_percent", 4)), ["cell", "district", "risk_percent"])


DOCS = f"{WEATHER}, daily AS (SELECT district, state, date, avg(tmax) AS tmax, sum(rain) AS rain FROM weather GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY district, state ORDER BY date) AS k FROM daily), doc AS (SELECT district, state, list(tmax ORDER BY date) AS t, list(coalesce(rain, 0.0) ORDER BY date) AS p FROM k WHERE k <= 43 GROUP BY 1, 2)"


@query(f"WITH {DOCS} SELECT district, state, len(t) AS days, round(list_avg(t[-7:]), 6) AS tmax_lag_1, round(list_avg(t[-14:-8]), 6) AS tmax_lag_2, round(list_avg(t[-28:-22]), 6) AS tmax_lag_4, round(list_sum(p[-14:]), 6) AS rain_roll_sum_2w, round(list_sum(p[-42:-36]), 6) AS rain_lag_6 FROM doc WHERE len(t) >= 42")
def weather_doc_features(spark, d):
    daily = T.weather_daily(spark, d).groupBy(*KEYS, "date").agg(F.avg("tmax").alias("tmax"), F.sum("rain").alias("rain"))
    # the first 43 days of each place: a document of fixed length
    first = daily.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("date"))).where("k <= 43")
    docs = first.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("date", "tmax", F.coalesce("rain", F.lit(0.0)).alias("rain")))).alias("daily"))
    docs = docs.select(*KEYS, F.col("daily.tmax").alias("t"), F.col("daily.rain").alias("p")).where(F.size("t") >= 42)
    mean = lambda a, b: F.round(X.array_mean(X.tail_slice("t", a, b)), 6)
    total = lambda a, b: F.round(X.array_sum(X.tail_slice("p", a, b)), 6)
    return docs.select(*KEYS, F.size("t").cast("long").alias("days"), mean(7, 0).alias("tmax_lag_1"), mean(14, 7).alias("tmax_lag_2"), mean(28, 21).alias("tmax_lag_4"), total(14, 0).alias("rain_roll_sum_2w"), total(42, 35).alias("rain_lag_6"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def parsed_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return T.table(spark, d, "events").groupBy((k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


# ---- serving, sets and samples -----------------------------------------------------------------


@query(f"WITH {PANEL} SELECT max(year) AS latest_year, max(week) FILTER (year = (SELECT max(year) FROM panel)) AS latest_week, count(DISTINCT disease) AS diseases, min(disease) AS first_disease FROM panel", latest_year="INTEGER", latest_week="INTEGER")
def metadata(spark, d):
    rows = T.cell_panel(spark, d)
    last = F.max(F.struct("year", "week"))
    return rows.agg(last["year"].alias("latest_year"), last["week"].alias("latest_week"), F.countDistinct("disease").alias("diseases"), F.min("disease").alias("first_disease"))


@query(f"WITH {PANEL} SELECT * FROM (SELECT year, week, disease, round(value, 6) AS value FROM panel WHERE cell = 7 AND disease = 'view' ORDER BY 1 DESC, 2 DESC LIMIT 12)", year="INTEGER", week="INTEGER")
def cell_history(spark, d):
    rows = T.cell_panel(spark, d).where("cell = 7 and disease = 'view'")
    return risk.history(rows, "value").select("year", "week", F.lit("view").alias("disease"), F.round("value", 6).alias("value"))


@query(f"WITH {RISK_A}, {RISK_B} SELECT risk_a.cell, CASE WHEN EXISTS (SELECT 1 FROM risk_b WHERE risk_b.cell = risk_a.cell) THEN 'local' ELSE 'global' END AS source FROM risk_a")
def explanation_source(spark, d):
    b = T.risk_b(spark, d).select("cell", F.lit("local").alias("source"))
    return T.risk_a(spark, d).join(b, "cell", "left").select("cell", F.coalesce("source", F.lit("global")).alias("source"))


@query(f"WITH {RISK_A}, p AS (SELECT {PERCENT.format(v='a', m='(SELECT max(a) FROM risk_a)')} AS p FROM risk_a) SELECT CASE WHEN p >= 75 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM p GROUP BY 1")
def percent_bands(spark, d):
    rows = risk.with_percent(T.risk_a(spark, d), "a")
    return rows.groupBy(X.percent_band("risk_percent").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS cell FROM customer ORDER BY ((c_custkey + 42) * 2654435761) % 4294967296, c_custkey LIMIT 50")
def seeded_sample(spark, d):
    return risk.hash_sample(T.table(spark, d, "customer").select(F.col("c_custkey").alias("cell")), 50)


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS both_, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS only_first, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS either")
def set_operations(spark, d):
    orders = T.table(spark, d, "orders").where("o_orderstatus in ('F', 'P')")
    # one aggregation with two flags answers intersect, except and union at once
    flags = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    return flags.agg(F.count_if(F.col("f") & F.col("p")).alias("both_"), F.count_if(F.col("f") & ~F.col("p")).alias("only_first"), F.count(F.lit(1)).alias("either"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) AS k FROM lineitem) WHERE k = 1")
def dedupe_keep_last(spark, d):
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return risk.keep_one(rows, ["l_orderkey", "l_linenumber"], "l_shipdate")


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg((l_quantity - m) / sd), 6) AS mean_z, round(max((l_quantity - m) / sd), 6) AS max_z FROM lineitem, s GROUP BY 1")
def standardised_columns(spark, d):
    rows = models.standardised(T.table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_quantity"]).groupBy("l_returnflag")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_z"), F.round(F.max("l_quantity"), 6).alias("max_z"))


@query(f"WITH {WEATHER} SELECT district, state, count(*) AS days, count(*) - count(rain) AS missing, round(CAST(count(*) - count(rain) AS DOUBLE) / count(*) * 100, 4) AS missing_percent FROM weather GROUP BY 1, 2")
def missing_rain(spark, d):
    missing = F.count_if(F.col("rain").isNull())
    rows = T.weather_daily(spark, d).groupBy(*KEYS)
    return rows.agg(F.count(F.lit(1)).alias("days"), missing.alias("missing"), F.round(X.ratio(missing, F.count(F.lit(1))) * 100, 4).alias("missing_percent"))


@query(f"WITH {PANEL} SELECT week, (week + 2) % 52 + 1 AS target_week, count(*) AS n FROM panel GROUP BY 1, 2", week="INTEGER", target_week="INTEGER")
def target_weeks(spark, d):
    return T.cell_panel(spark, d).groupBy("week", X.target_week("week", 3).alias("target_week")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GI} SELECT CAST(floor(least(1.0, greatest(0.0, (z + 2.0) / 6.0)) * 255) AS INTEGER) AS red, count(*) AS n FROM gi GROUP BY 1")
def heat_colours(spark, d):
    return gi_scores(spark, d).groupBy(X.z_colour("z").alias("red")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WEEKS} SELECT state, week, sin_week FROM (SELECT state, weekofyear(monday) AS week, round(sin(2.0 * pi() * weekofyear(monday) / 52.0), 6) + 0.0 AS sin_week, sum(cases) AS s FROM dense GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY state ORDER BY s DESC, week) = 1", week="INTEGER")
def peak_week(spark, d):
    rows = dense_cases(spark, d).groupBy("state", X.iso_week("monday").alias("week")).agg(F.sum("cases").alias("s"))
    best = risk.top_of_group(rows, ["state"], "s", "week")
    return best.select("state", "week", (F.round(X.season("week")[0], 6) + 0.0).alias("sin_week"))


@query(f"WITH g AS (SELECT q, r, CAST(68 AS DOUBLE) + CAST(0.03 AS DOUBLE) * q + CAST(0.015 AS DOUBLE) * (r % 2) AS center_lon, CAST(8 AS DOUBLE) + CAST(0.03 AS DOUBLE) * r AS center_lat FROM (SELECT unnest(range(0, 50)) AS q), (SELECT unnest(range(0, 50)) AS r)), w AS (SELECT *, floor((center_lon - 67.995) / {WARD_W}) AS wx, floor((center_lat - 7.995) / {WARD_H}) AS wy FROM g) SELECT CAST(wx * 100 + wy AS BIGINT) AS ward_id, q, r, center_lon, center_lat FROM w WHERE wx BETWEEN 0 AND 3 AND wy BETWEEN 0 AND 2 AND NOT (wx = 1 AND wy = 1 AND center_lon > 67.995 + {WARD_W} * 1.25 AND center_lon < 67.995 + {WARD_W} * 1.75 AND center_lat > 7.995 + {WARD_H} * 1.25 AND center_lat < 7.995 + {WARD_H} * 1.75)")
def polygon_cells(spark, d):
    return spatial.cells_of_polygons(wards(spark), ["ward_id"])


HOLDOUT = "CAST('0x' || substr(md5(district || '|' || state), 1, 8) AS BIGINT) % 100 < 15"


@query(f"WITH {PLACES} SELECT district, state, {HOLDOUT} AS is_spatial_holdout FROM places")
def spatial_holdout(spark, d):
    return T.places(spark, d).select("district", "state", panel.spatial_holdout(KEYS).alias("is_spatial_holdout"))


@query(f"WITH {GI}, t AS (SELECT cell, z, 1 / (1 + CAST(0.2316419 AS DOUBLE) * abs(z)) AS t FROM gi) SELECT cell, round(z, 6) AS z, round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (CAST(0.319381530 AS DOUBLE) + t * (CAST(-0.356563782 AS DOUBLE) + t * (CAST(1.781477937 AS DOUBLE) + t * (CAST(-1.821255978 AS DOUBLE) + t * CAST(1.330274429 AS DOUBLE))))), 6) AS p FROM t")
def p_values(spark, d):
    return gi_scores(spark, d).select("cell", F.round("z", 6).alias("z"), F.round(X.normal_p_value("z"), 6).alias("p"))


# ---- models ------------------------------------------------------------------------------------


def training_panel(spark, d) -> DataFrame:
    """Places by weeks with lags, leads and rolling values; written once, as each pass of a fit would join the orders again."""
    rows = panel.leads(panel.lags(dense_cases(spark, d), KEYS, "cases", [1, 2, 3, 4, 8]), KEYS, "cases", [1, 2, 3, 4])
    rows = panel.rolling_cases(rows, KEYS, "cases").withColumn("week", X.iso_week("monday")).withColumn("year", X.iso_year("monday"))
    sin, cos = X.season("week")
    return materialised(rows.withColumn("sin_week", sin).withColumn("cos_week", cos))


LEADED = f"""{WEEKS}, f AS (SELECT district, state, monday, isoyear(monday) AS year, weekofyear(monday) AS week, lag(cases) OVER {OVER}) AS l1, {', '.join(f'lead(cases, {k}) OVER {OVER}) AS y{k}' for k in (1, 2, 3, 4))} FROM dense),
  test AS (SELECT district, state, week, horizon, l1, [y1, y2, y3, y4][horizon] AS y, {HOLDOUT} AS is_holdout FROM f, (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS horizon) WHERE year >= 1999),
  m AS (SELECT district, state, week, avg(l1) AS p FROM f WHERE year < 1999 GROUP BY 1, 2, 3)"""
LEADS = (1, 2, 3, 4)


def held_back(spark, d) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows): all years to 1998, and from 1999 on each horizon's actual value y."""
    rows = training_panel(spark, d).withColumn("is_holdout", panel.spatial_holdout(KEYS))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"cases_lead_{k}").alias("y")) for k in LEADS])).alias("h")
    test = rows.where("year >= 1999").select(*KEYS, "week", "is_holdout", "cases_lag_1", each).select("*", "h.*").drop("h")
    return rows.where("year < 1999"), test.where("y is not null")


@query(f"WITH {LEADED} SELECT horizon, {_regression_sql('y', 'l1')} FROM test WHERE y IS NOT NULL AND l1 IS NOT NULL GROUP BY 1")
def naive_baseline_metrics(spark, d):
    rows = models.naive(held_back(spark, d)[1], "cases_lag_1")
    return evaluate.regression_metrics(rows.where("pred_naive is not null"), ["horizon"], "y", "pred_naive")


@query(f"WITH {LEADED} SELECT horizon, {_regression_sql('y', 'coalesce(p, 0.0)')} FROM test LEFT JOIN m USING (district, state, week) WHERE y IS NOT NULL GROUP BY 1")
def seasonal_baseline_metrics(spark, d):
    train, test = held_back(spark, d)
    scored = models.seasonal(train, test, [*KEYS, "week"], "cases_lag_1")
    return evaluate.regression_metrics(scored, ["horizon"], "y", "pred_seasonal")


@query(f"WITH {LEADED}, s AS (SELECT horizon, y, l1, coalesce(p, 0.0) AS p, CASE WHEN is_holdout THEN 'Test (Spatial Holdout)' ELSE 'Test (Seen Districts)' END AS split FROM test LEFT JOIN m USING (district, state, week) WHERE y IS NOT NULL), both_ AS (SELECT 'naive' AS model, horizon, split, y, l1 AS q FROM s WHERE l1 IS NOT NULL UNION ALL SELECT 'seasonal', horizon, split, y, p FROM s) SELECT model, horizon, split, {_regression_sql('y', 'q')} FROM both_ GROUP BY 1, 2, 3")
def split_table(spark, d):
    """Both baselines at each horizon, in seen districts and in those held out."""
    train, test = held_back(spark, d)
    rows = models.naive(models.seasonal(train, test, [*KEYS, "week"], "cases_lag_1"), "cases_lag_1")
    rows = rows.withColumn("split", F.when(F.col("is_holdout"), "Test (Spatial Holdout)").otherwise("Test (Seen Districts)"))
    rows = rows.select("horizon", "split", "y", F.col("pred_naive").alias("naive"), F.col("pred_seasonal").alias("seasonal"))
    return evaluate.regression_metrics(rows.unpivot(["horizon", "split", "y"], ["naive", "seasonal"], "model", "q").where("q is not null"), ["model", "horizon", "split"], "y", "q")


def _tree_scores(spark, d, kind, lead=1, **params):
    rows = training_panel(spark, d)
    features, target = models.feature_columns(rows), f"cases_lead_{lead}"
    model = models.fit_delta(rows.where("year < 1999"), features, target, "cases_lag_1", kind, **params)
    test = rows.where("year >= 1999").where(F.col(target).isNotNull())
    return models.score_delta(model, test, features, "cases_lag_1", "pred").select(*KEYS, "monday", target, "pred")


@query()
def gbt_delta_score(spark, d):
    """Ten rounds: the panel of the test tables is small, and level-wise trees match no leaf-wise model anyway."""
    return _tree_scores(spark, d, "gbt", maxIter=10)


@query()
def gbt_deep_score(spark, d):
    """The second booster: deeper trees of sampled rows and columns at a lower rate, again with ten rounds."""
    return _tree_scores(spark, d, "gbt", maxIter=10, maxDepth=6, stepSize=0.06, subsamplingRate=0.85, featureSubsetStrategy="0.85")


@query()
def rf_score(spark, d):
    return _tree_scores(spark, d, "rf", numTrees=10)


@query()
def tree_shap(spark, d):
    rows = training_panel(spark, d)
    features = models.feature_columns(rows)
    model = models.fit_delta(rows.where("year < 1999"), features, "cases_lead_1", "cases_lag_1", maxIter=5, maxDepth=3)
    # the latest week only: contributions are wanted for what is served
    latest = models.with_missing(risk.latest_period(rows), features)
    return treeshap.shap_values(model, latest, features, ["district", "state"])


@query()
def benchmark_gate(spark, d):
    """Whether the boosted model beats the seasonal mean one, two and four weeks ahead, with both r2."""
    scored = [_tree_scores(spark, d, "gbt", k, maxIter=10).select(F.lit(k).alias("horizon"), F.col(f"cases_lead_{k}").alias("y"), "pred") for k in (1, 2, 4)]
    tree = evaluate.regression_metrics(risk.union_all(scored), ["horizon"], "y", "pred").select("horizon", F.col("r2").alias("tree_r2"))
    base = seasonal_baseline_metrics(spark, d).select("horizon", F.col("r2").alias("seasonal_r2"))
    return tree.join(base, "horizon").withColumn("passes", F.col("tree_r2") > F.col("seasonal_r2"))


@query()
def ablation(spark, d):
    rows = training_panel(spark, d)
    groups = explain.ablation_scenarios(models.feature_columns(rows))
    return models.ablation(rows.where("year < 1999"), rows.where("year >= 1999"), groups, "cases_lead_1", "cases_lag_1")


@query()
def poisson_disagg(spark, d):
    rows = models.synthetic_world(spark)
    rows = rows.join(rows.groupBy("district").agg(F.sum("true_cases").alias("total")), "district").withColumn("one", F.lit(1.0))
    beta = models.poisson_fit(rows, ["district"], "population", ["one", "ndvi", "rainfall"], "total")
    eta = F.lit(beta[0]) + F.lit(beta[1]) * F.col("ndvi") + F.lit(beta[2]) * F.col("rainfall")
    out = panel.mass_preserving(rows.withColumn("mu", F.col("population") * F.exp(eta)), ["district"], "mu", "total", "estimate")
    return out.select("district", "gx", "gy", "true_cases", "estimate")


# ---- streaming ---------------------------------------------------------------------------------


@query("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS monday, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly_cases(spark, d):
    schema = T.table(spark, d, "events").schema
    # a glob, as the stream's source is a folder or a pattern, and the table may be one file
    source = stream.event_stream(spark, f"{d}/events.parque[t]", schema)
    rows = stream.weekly(source, ["event_type"], "value")
    checkpoint = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.drained(rows, f"{checkpoint}-rows", checkpoint)
    return out.select("event_type", "monday", F.round("total", 4).alias("total"), "n")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_activity(spark, d):
    return stream.sessions(T.table(spark, d, "events"), "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
