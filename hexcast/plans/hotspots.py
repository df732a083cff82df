"""Registered queries of hot spots over weeks and of their regions, each beside its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hexcast.functions.exprs import exact_sum, week_index, week_start
from hexcast.operators import regions
from hexcast.plans.queries import query
from hexcast.session import shared_folder
from hexcast.sources import tables as T
from hexcast.streaming import hotspots
from hexcast.streaming import weekly as stream

BOUND = 700.0
WEEKLY = """weekly AS (SELECT user_id AS cell, CAST(date_diff('day', DATE '1969-12-29', CAST(date_trunc('week', ts) AS DATE)) / 7 AS INTEGER) AS week, sum(value) AS total FROM events GROUP BY 1, 2)"""
EVOLUTION = f"""WITH {WEEKLY}, a AS (SELECT *, total > {BOUND} AS hot, lag(week) OVER w = week - 1 AS near, lag(total) OVER w AS before FROM weekly WINDOW w AS (PARTITION BY cell ORDER BY week)),
b AS (SELECT *, coalesce(near AND before > {BOUND}, false) AS was FROM a), c AS (SELECT *, sum(CASE WHEN hot AND was THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY week) AS run FROM b),
d AS (SELECT *, CAST(CASE WHEN hot THEN row_number() OVER (PARTITION BY cell, run ORDER BY week) ELSE 0 END AS INTEGER) AS weeks FROM c)
SELECT cell, week, round(total, 4) AS total, hot, weeks, min(CASE WHEN hot THEN week END) OVER (PARTITION BY cell ORDER BY week) AS first_detection, max(CASE WHEN hot THEN week END) OVER (PARTITION BY cell ORDER BY week) AS last_detection,
  CASE WHEN weeks >= 3 THEN 'Persistent' WHEN hot AND was AND total > before THEN 'Intensifying' WHEN hot THEN 'Emerging' WHEN was THEN 'Diminishing' ELSE 'Non-Hotspot' END AS label FROM d"""


def weekly_totals(spark, d):
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("cell"), week_index(week_start("ts")).cast("int").alias("week"), "value")
    return rows.groupBy("cell", "week").agg(exact_sum("value").alias("total"))


@query(EVOLUTION)
def hotspot_evolution(spark, d):
    """Duration, first and last detection and label of every cell and week."""
    return hotspots.evolution(weekly_totals(spark, d), BOUND).withColumn("total", F.round("total", 4))


@query(EVOLUTION)
def hotspot_evolution_stream(spark, d):
    """The same rows from the stream of events, by a state for each cell.

    The files of a table come in any order, so a row may be as late as the table is long: none is left out.
    """
    table = T.table(spark, d, "events")
    days = table.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    events = stream.event_stream(spark, f"{d}/events.parque[t]", table.schema)
    told = hotspots.evolution_stream(events, BOUND, "user_id", "ts", "value", late=f"{days + 1} days")
    path = f"{shared_folder(spark)}/evolution-{uuid.uuid4().hex}"
    return hotspots.told_into(told, f"{path}/rows", f"{path}/checkpoint").withColumn("total", F.round("total", 4))


REGIONS = f"""WITH RECURSIVE {WEEKLY}, hot AS (SELECT week, cell, cell % 40 AS q, cell // 40 AS r FROM weekly WHERE total > {BOUND}),
edge AS (SELECT x.week, x.cell AS a, y.cell AS b FROM hot x JOIN hot y ON x.week = y.week AND (y.q - x.q, y.r - x.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))),
reach AS (SELECT week, cell AS a, cell AS b FROM hot UNION SELECT r.week, r.a, e.b FROM reach r JOIN edge e ON e.week = r.week AND e.a = r.b),
region AS (SELECT week, a AS cell, min(b) AS region FROM reach GROUP BY 1, 2)"""


def hot_cells(spark, d):
    rows = weekly_totals(spark, d).where(F.col("total") > BOUND)
    return rows.withColumn("q", F.col("cell") % T.GRID_COLUMNS).withColumn("r", F.floor(F.col("cell") / T.GRID_COLUMNS))


@query(f"{REGIONS} SELECT week, cell, region FROM region")
def hotspot_regions(spark, d):
    return regions.hot_regions(hot_cells(spark, d))


@query(f"""{REGIONS}, size AS (SELECT week, region, count(*) AS cells FROM region GROUP BY 1, 2),
link AS (SELECT DISTINCT x.week, x.region, y.region AS next_region FROM region x JOIN region y ON y.week = x.week + 1 AND y.cell = x.cell),
heir AS (SELECT week, region, count(*) AS goes_to FROM link GROUP BY 1, 2),
came AS (SELECT week + 1 AS week, next_region AS region, count(*) AS came_from, max(goes_to) AS siblings, sum(cells) AS before FROM link JOIN heir USING (week, region) JOIN size USING (week, region) GROUP BY 1, 2)
SELECT week, region, cells, coalesce(came_from, 0) AS came_from, coalesce(goes_to, 0) AS goes_to,
  CASE WHEN came_from IS NULL THEN 'Birth' WHEN came_from > 1 THEN 'Merge' WHEN siblings > 1 THEN 'Split' WHEN cells > before THEN 'Expanding' WHEN cells < before THEN 'Shrinking' ELSE 'Steady' END AS event
FROM size LEFT JOIN came USING (week, region) LEFT JOIN heir USING (week, region)""")
def hotspot_region_events(spark, d):
    """Births, merges, splits and growth of the regions of hot cells."""
    return regions.region_events(regions.hot_regions(hot_cells(spark, d)))
