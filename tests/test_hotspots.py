"""Hot spots over weeks as a stream with late rows, and regions against brute force."""

import datetime
import functools
import os
import random

import duckdb
from pyspark.sql import functions as F

from hexcast.functions.exprs import exact_sum
from hexcast.operators import regions
from hexcast.plans import hotspots as plans
from hexcast.sources import tables as T
from hexcast.streaming import hotspots

EVENTS = "cell long, ts timestamp, value double"
BOUND_CENTS = [72.87, 114.56, 106.58, 17.11, 66.59, 13.41, 5.66, 303.22]  # 700.00; as doubles added in turn, either way, more


def weekly(rows):
    out = {}
    for cell, ts, value in rows:
        if cell is not None and ts is not None:
            week = (ts.date() - datetime.date(1969, 12, 29)).days // 7
            out[cell, week] = out.get((cell, week), 0.0) + (value or 0.0)
    return out


def test_late_rows_correct_what_the_stream_told(spark, tmp_path):
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), start + datetime.timedelta(hours=rng.randrange(24 * 7 * 20)), float(rng.randrange(30))) for _ in range(700)]
    rows.sort(key=lambda r: r[1])
    late = rows[100:400:9]  # arrive up to a week after later ones
    rest = [r for r in rows if r not in late]
    batches = [rest[:200], rest[200:330] + late[:10], rest[330:450] + late[10:], rest[450:], [(None, start, 1.0), (3, None, 1.0)]]
    folder = f"{tmp_path}/events"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    told = hotspots.evolution_stream(stream, 40.0, "cell", "ts", "value", late="60 days", keep=9)
    got = hotspots.told_into(told, f"{tmp_path}/told", f"{tmp_path}/check")
    totals = weekly(r for b in batches for r in b)
    want = hotspots.evolution(spark.createDataFrame([(c, w, v) for (c, w), v in totals.items()], "cell long, week int, total double"), 40.0)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    every = spark.read.parquet(f"{tmp_path}/told/told=*")
    assert every.groupBy("cell", "week").agg(F.countDistinct("total").alias("n")).where("n > 1").count() > 0  # some rows were corrected


def test_weeks_far_behind_the_watermark_are_folded(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    folder = f"{tmp_path}/events"
    for k in range(12):  # a file of two weeks each, always hot
        rows = [(1, start + datetime.timedelta(days=14 * k + d), 50.0) for d in (0, 7)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{k:02d}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    told = hotspots.evolution_stream(stream, 40.0, "cell", "ts", "value", late="1 day", keep=2)
    got = sorted(hotspots.told_into(told, f"{tmp_path}/told", f"{tmp_path}/check").collect(), key=lambda r: r["week"])
    assert [r["weeks"] for r in got] == list(range(1, 25)) and {r["first_detection"] for r in got} == {got[0]["week"]}
    assert [r["label"] for r in got][:3] == ["Emerging", "Emerging", "Persistent"]


def test_evolution_of_gaps_and_nulls(spark):
    rows = [(1, 1, 9.0), (1, 2, 9.5), (1, 3, 1.0), (1, 5, 9.0), (1, 6, None), (2, 1, 0.0)]
    got = hotspots.evolution(spark.createDataFrame(rows, "cell long, week int, total double"), 5.0).orderBy("cell", "week").collect()
    assert [(r["weeks"], r["first_detection"], r["last_detection"], r["label"]) for r in got] == [
        (1, 1, 1, "Emerging"), (2, 1, 2, "Intensifying"), (0, 1, 2, "Diminishing"), (1, 1, 5, "Emerging"), (0, 1, 5, "Diminishing"), (0, None, None, "Non-Hotspot"),
    ]
    assert hotspots.evolution(spark.createDataFrame([], "cell long, week int, total double"), 5.0).count() == 0


def test_evolution_of_events_without_time_or_value_is_that_of_the_sql(spark, tmp_path):
    """A week of null values is neither hot nor not; events without a time come after a cell's weeks (F4)."""
    monday = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, 800.0), (1, 7, None), (1, 14, 750.0), (1, None, 900.0), (2, 0, 5.0), (2, None, 6.0), (3, None, None), (None, 0, 800.0), (None, 7, 900.0), (None, None, 1.0)]
    rows = [(cell, None if day is None else monday + datetime.timedelta(days=day), value) for cell, day, value in rows]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = plans.hotspot_evolution(spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.EVOLUTION})").fetchall()
    assert len(want) == 10 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def brute_regions(hot):
    out = {}
    for w in {w for w, *_ in hot}:
        cells = {(q, r): c for week, c, q, r in hot if week == w}
        left = set(cells)
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                q, r = todo.pop()
                group.add((q, r))
                for dq, dr in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
                    if (q + dq, r + dr) in left:
                        left.discard((q + dq, r + dr))
                        todo.append((q + dq, r + dr))
            out |= {(w, cells[p]): min(cells[x] for x in group) for p in group}
    return out


def test_regions_by_brute_force(spark):
    rng = random.Random(6)
    hot = [(w, q * 100 + r, q, r) for w in range(4) for q in range(14) for r in range(14) if rng.random() < 0.42]
    hot += [(9, 5_000 + q, q, 50) for q in range(60)]  # a long chain
    got = regions.hot_regions(spark.createDataFrame(hot, "week int, cell long, q long, r long"))
    want = brute_regions(hot)
    assert {(r["week"], r["cell"]): r["region"] for r in got.collect()} == want and got.count() == len(hot)
    events = {(r["week"], r["region"]): r for r in regions.region_events(got).collect()}
    for (w, region), row in events.items():
        own = {c for (week, c), g in want.items() if week == w and g == region}
        before = {want[w - 1, c] for c in own if (w - 1, c) in want}
        after = {want[w + 1, c] for c in own if (w + 1, c) in want}
        assert (row["cells"], row["came_from"], row["goes_to"]) == (len(own), len(before), len(after))
        assert (row["event"] == "Birth") == (not before) and (row["event"] == "Merge") == (len(before) > 1)
    assert {r["event"] for r in events.values()} >= {"Birth", "Merge"}


def test_no_hot_cells_no_regions(spark):
    none = spark.createDataFrame([], "week int, cell long, q long, r long")
    assert regions.hot_regions(none).count() == 0 and regions.region_events(regions.hot_regions(none)).count() == 0


def test_rounds_of_components_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    kept = regions.materialised
    monkeypatch.setattr(regions, "materialised", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    hot = spark.createDataFrame([(w, c, c % 40, c // 40) for w in (1, 2) for c in (1, 2, 3, 50, 51)], "week int, cell long, q long, r long")
    events = regions.region_events(regions.hot_regions(hot))
    plans.append(events._jdf.queryExecution().executedPlan().toString())
    assert events.count() == 4 and len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_totals_do_not_depend_on_the_order_of_rows(spark):
    rows = [("cents", v) for v in (0.1, 0.2, 0.3)] + [("large", 1e300), ("large", 1.0), ("none", None), ("part", None), ("part", 2.5), ("fine", 1e-9), ("nan", float("nan"))]
    for order in (rows, rows[::-1]):
        got = dict(spark.createDataFrame(order, "k string, v double").coalesce(1).groupBy("k").agg(exact_sum("v")).collect())
        assert got["cents"] == 0.6 and got["large"] == 1e300 and got["none"] is None and got["part"] == 2.5 and got["fine"] == 1e-9 and got["nan"] != got["nan"]


def test_a_total_equal_to_the_bound_is_not_hot(spark, tmp_path):
    """Cents that make 700.00 or equal weeks, though doubles added in turn give more (F4); their risk keeps no such error (F2)."""
    monday = datetime.datetime(2024, 1, 1)
    weeks = {0: BOUND_CENTS, 7: [400.1, 400.2, 0.3], 14: [0.3, 400.2, 400.1]}
    rows = [(1, monday + datetime.timedelta(days=d), v) for d, values in weeks.items() for v in values]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = plans.hotspot_evolution(spark, str(tmp_path)).orderBy("week").collect()
    assert [(r["hot"], r["label"]) for r in got] == [(False, "Non-Hotspot"), (True, "Emerging"), (True, "Emerging")]
    spark.createDataFrame([(1, v) for v in BOUND_CENTS], "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert T.risk_a(spark, str(tmp_path)).first()["a"] == 0.007


def test_a_streamed_total_equal_to_the_bound_is_not_hot(spark, tmp_path):
    """The same by micro-batches, each of which adds to what the state holds (F5)."""
    for k, value in enumerate((0.1, 0.2, None)):
        spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), value)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events/*")
    told = hotspots.evolution_stream(stream, 0.3, "cell", "ts", "value")
    (row,) = hotspots.told_into(told, f"{tmp_path}/told", f"{tmp_path}/check").collect()
    assert (row["total"], row["hot"], row["label"]) == (0.3, False, "Non-Hotspot")


def test_a_risk_on_the_edge_of_rounding_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """123455.00 in cents is 1.23455 and goes up to 1.2346; doubles added in turn give 123454.99999999999 one way round (F2)."""
    for k, prices in enumerate(([29700.51, 53144.65, 40609.84], [40609.84, 53144.65, 29700.51])):
        spark.createDataFrame([(1, v) for v in prices], "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/{k}/orders.parquet")
        assert T.risk_a(spark, f"{tmp_path}/{k}").select(F.round("a", 4)).first()[0] == 1.2346


def test_the_streamed_query_keeps_rows_of_files_in_any_order(spark, tmp_path, monkeypatch):
    """Files of a table from the last weeks to the first, one to a micro-batch: the batch query's rows (F5)."""
    monkeypatch.setattr(plans.stream, "event_stream", functools.partial(plans.stream.event_stream, per_trigger=1))
    for k in range(5):
        start = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=21 * (4 - k))
        rows = [(cell, start + datetime.timedelta(days=d), 360.0 * cell) for cell in (1, 2) for d in (0, 2, 7)]
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        for part in (tmp_path / "events.parquet").glob("*.parquet"):
            if part.stat().st_mtime > 1_000_000:  # the stream takes files by age
                os.utime(part, (1_000 * (k + 1), 1_000 * (k + 1)))
    want = plans.hotspot_evolution(spark, str(tmp_path)).collect()
    got = plans.hotspot_evolution_stream(spark, str(tmp_path)).collect()
    assert len(want) == 20 and sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
