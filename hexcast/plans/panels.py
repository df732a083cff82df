"""Registered queries of joined panels, explanations with a fallback, set differences and grids of metrics, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcast.functions import hexbatch
from hexcast.functions.exprs import hex_text
from hexcast.operators import evaluate, explain, panel, risk, spatial
from hexcast.plans import queries as Q
from hexcast.plans.hexagons import TABLES, cells_sql
from hexcast.plans.queries import CELLS, KEYS, OVER, PLACES, RISK_A, WEATHER, WEEKLY, WEEKS, query
from hexcast.sources import tables as T

# ---- joins of three sources --------------------------------------------------------------------

SOURCES = f"""{WEATHER}, rain AS (SELECT district, state, date, sum(rain) AS rain FROM weather GROUP BY 1, 2, 3),
warm AS (SELECT district, state, date, avg(tmax) AS tmax FROM weather WHERE tmax > 22 GROUP BY 1, 2, 3),
cases AS (SELECT district, state, CAST(o_orderdate AS DATE) AS date, count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON key = c_nationkey GROUP BY 1, 2, 3)"""
DAY = [*KEYS, "date"]


def three_sources(spark, d):
    """Daily rain and warmth by supplier's place, and daily cases by customer's: three tables on one key."""
    weather = T.weather_daily(spark, d)
    rain = weather.groupBy(*DAY).agg(F.sum("rain").alias("rain"))
    warm = weather.where("tmax > 22").groupBy(*DAY).agg(F.round(F.avg("tmax"), 6).alias("tmax"))
    home = T.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("key")).join(F.broadcast(T.places(spark, d)), "key")  # 25 places
    orders = T.table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderdate").cast("date").alias("date"))
    cases = orders.join(home, "cell").groupBy(*DAY).agg(F.count(F.lit(1)).alias("cases"))
    return rain, warm, cases


@query(f"WITH {SOURCES} SELECT district, state, date, rain, round(tmax, 6) AS tmax, cases FROM rain JOIN warm USING (district, state, date) JOIN cases USING (district, state, date)")
def days_in_all_sources(spark, d):
    """Days that all three sources have; the joins share one key, and so one partitioning."""
    rain, warm, cases = three_sources(spark, d)
    return rain.join(warm, DAY).join(cases, DAY)


@query(f"WITH {SOURCES} SELECT district, state, date, rain, round(tmax, 6) AS tmax, coalesce(cases, 0) AS cases FROM rain LEFT JOIN warm USING (district, state, date) LEFT JOIN cases USING (district, state, date)")
def days_of_rain_with_the_rest(spark, d):
    """Every day of the rain source, with warmth and cases where they are known."""
    rain, warm, cases = three_sources(spark, d)
    return rain.join(warm, DAY, "left").join(cases, DAY, "left").withColumn("cases", F.coalesce("cases", F.lit(0).cast("long")))


def _lags(column: str, weeks: list[int]) -> str:
    return ", ".join(f"lag({column}, {k}) OVER {OVER}) AS {column}_lag_{k}" for k in weeks)


@query(f"WITH {WEATHER}, w AS ({WEEKLY}), {WEEKS.removeprefix(PLACES + ', ')}, f AS (SELECT district, state, monday, coalesce(rain, 0.0) AS rain, round(tmax, 6) AS tmax FROM dense LEFT JOIN w USING (district, state, monday)) SELECT district, state, monday, rain, tmax, {_lags('rain', [1, 2, 4, 6])}, {_lags('tmax', [1, 2, 4])} FROM f")
def weather_lags(spark, d):
    """Rain of 1, 2, 4 and 6 weeks ago and temperature of 1, 2 and 4."""
    rows = Q.weekly_weather_left(spark, d).select(*KEYS, "monday", "rain", "tmax")
    return panel.lags(panel.lags(rows, KEYS, "rain", [1, 2, 4, 6]), KEYS, "tmax", [1, 2, 4])


# ---- differences and fallbacks -----------------------------------------------------------------


@query("SELECT o_custkey AS cell, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def difference_rows(spark, d):
    """Rows of one set that the other lacks, as often as it lacks them."""
    rows = T.table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    side = lambda s: rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return side("F").exceptAll(side("O"))


@query("SELECT o_custkey AS cell, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def intersection_rows(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    side = lambda s: rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return side("F").intersect(side("O"))


#: hexagons of the twenty cells of highest risk; a district without one gets the hexagon of its cells' mean place
TOPS = f"""{TABLES}, {CELLS}, {RISK_A}, top AS (SELECT cell, district, state, center_lat, center_lon FROM cells JOIN risk_a USING (cell) ORDER BY round(a, 7) DESC, cell LIMIT 20),
mean AS (SELECT district, state, round(avg(center_lat), 5) AS lat, round(avg(center_lon), 5) AS lon FROM cells GROUP BY 1, 2),
bare AS (SELECT * FROM mean ANTI JOIN top USING (district, state)),
src AS (SELECT {{'d': district, 's': state, 'fallback': 0, 'cell': cell}} AS key, center_lat AS lat, center_lon AS lon FROM top UNION ALL SELECT {{'d': district, 's': state, 'fallback': 1, 'cell': 0}}, lat, lon FROM bare), {cells_sql('hex', 'src', 5)}"""


@query(f"WITH {TOPS}, o AS (SELECT key.d AS district, key.s AS state, key.fallback = 1 AS is_fallback, lower(to_hex(hexagon)) AS hexagon, row_number() OVER (PARTITION BY hexagon ORDER BY key.fallback DESC, key.d DESC, key.s DESC) AS k FROM hex) SELECT hexagon, district, state, is_fallback FROM o WHERE k = 1")
def hexagons_with_fallback(spark, d):
    """Hexagons of the riskiest cells, with a fallback for each district that has none; where two fall together the fallback wins."""
    cells = T.cells(spark, d)
    ranked = cells.join(T.risk_a(spark, d), "cell").withColumn("a", F.round("a", 7))
    top = risk.top_n(ranked, "a", 20).select("district", "state", "center_lat", "center_lon")
    mean = cells.groupBy(*KEYS).agg(F.round(F.avg("center_lat"), 5).alias("center_lat"), F.round(F.avg("center_lon"), 5).alias("center_lon"))
    bare = spatial.without_match(mean, top, KEYS)
    rows = top.withColumn("is_fallback", F.lit(False)).unionByName(bare.withColumn("is_fallback", F.lit(True)))
    rows = rows.select(hexbatch.cells_at(F.col("center_lat"), F.col("center_lon"), 5).alias("hexagon"), "district", "state", "is_fallback")
    rows = rows.withColumn("order", F.struct("is_fallback", "district", "state"))
    return risk.keep_one(rows, ["hexagon"], "order").select(hex_text("hexagon").alias("hexagon"), "district", "state", "is_fallback")


# ---- explanations ------------------------------------------------------------------------------

TOP_FEATURES = 15
SHAP = "v AS (SELECT vec_id AS cell, label, unnest(range(len(embedding))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


@query(f"""WITH {SHAP}, own AS (SELECT cell, feature, round(abs(value), 6) AS importance, row_number() OVER (PARTITION BY cell ORDER BY abs(value) DESC, feature) AS rank FROM v WHERE label = 0),
every AS (SELECT feature, round(sum(abs(value)) / count(*), 6) AS importance FROM v WHERE label = 0 GROUP BY 1), whole AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM every),
grid AS (SELECT c_custkey AS cell FROM customer)
SELECT cell, 'local' AS source, rank, feature, importance FROM own SEMI JOIN grid USING (cell) WHERE rank <= {TOP_FEATURES}
UNION ALL SELECT cell, 'global', rank, feature, importance FROM grid ANTI JOIN own USING (cell), whole WHERE rank <= {TOP_FEATURES}""", feature="INTEGER", rank="INTEGER")
def cell_explanations(spark, d):
    """The most important features of every cell: its own contributions where it has some, else those of all cells together."""
    values = T.shap_rows(spark, d).where("disease = 0")
    grid = T.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    return explain.with_fallback(grid, values, TOP_FEATURES).select("cell", "source", "rank", F.col("feature").cast("int").alias("feature"), F.round("importance", 6).alias("importance"))


# ---- metrics -----------------------------------------------------------------------------------

FLAGS2 = """f AS (SELECT unnest([1, 2, 3, 4]) AS horizon, l_suppkey % 100 < 15 AS is_holdout, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem),
long AS (SELECT horizon, unnest(['all', CASE WHEN is_holdout THEN 'holdout' ELSE 'seen' END]) AS split, unnest([1, 1]) AS one, l_extendedprice > 40000 AS a1, l_quantity > 10 * horizon AS p1, l_discount > 0.05 AS a2, l_tax > 0.01 * horizon AS p2 FROM f),
both_ AS (SELECT 'first' AS disease, horizon, split, a1 AS actual, p1 AS predicted FROM long UNION ALL SELECT 'second', horizon, split, a2, p2 FROM long)"""


@query(f"WITH {FLAGS2} {Q._scores_sql('disease, horizon, split', 'both_')}", tp="BIGINT", fp="BIGINT", fn="BIGINT", tn="BIGINT")
def metric_grid(spark, d):
    """Scores of two diseases at four horizons over three splits: 24 rows from one pass over the lines."""
    rows = T.table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("horizon"))
    one = F.struct(F.lit("first").alias("disease"), (F.col("l_extendedprice") > 40000).alias("actual"), (F.col("l_quantity") > 10 * F.col("horizon")).alias("predicted"))
    two = F.struct(F.lit("second").alias("disease"), (F.col("l_discount") > 0.05).alias("actual"), (F.col("l_tax") > 0.01 * F.col("horizon")).alias("predicted"))
    flags = rows.select("horizon", (F.col("l_suppkey") % 100 < 15).alias("is_holdout"), F.explode(F.array(one, two)).alias("x")).select("horizon", "is_holdout", "x.*")
    return evaluate.confusion(evaluate.with_splits(flags, "is_holdout"), ["disease", "horizon", "split"], "actual", "predicted")


@query(f"WITH {CELLS}, {RISK_A}, p AS (SELECT district, state, max(a) / (SELECT max(a) FROM risk_a) * 100 AS p FROM risk_a JOIN cells USING (cell) GROUP BY 1, 2) SELECT district, state, CASE WHEN p >= 70 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS badge FROM p")
def search_badges(spark, d):
    """The badge beside a found district, by its riskiest cell: from 70 and from 40 percent."""
    rows = T.risk_a(spark, d).join(T.cells(spark, d), "cell")
    top = T.risk_a(spark, d).agg(F.max("a").alias("top"))
    rows = rows.groupBy(*KEYS).agg(F.max("a").alias("a")).join(F.broadcast(top))  # one row
    share = F.col("a") / F.col("top") * 100
    return rows.select(*KEYS, F.when(share >= 70, "high").when(share >= 40, "medium").otherwise("low").alias("badge"))
