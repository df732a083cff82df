"""Versioned serving tables, cubes with pushed filters, and the live poll."""

import datetime
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from hexcast.sources import cubes, http as poll_source, snapshots


def cells(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.uniform(70, 80), rng.uniform(10, 20), rng.random() * 9, rng.choice(["A", "B"])) for k in range(n)]
    return spark.createDataFrame(rows, "cell long, lon double, lat double, a double, state string").repartition(4)


def test_a_box_opens_only_files_that_meet_it(spark, tmp_path):
    rows, path = cells(spark), f"file://{tmp_path}/serving"
    at = snapshots.publish(rows, path, "lon", "lat", "cell", ["a"], rows_per_file=200)
    every = snapshots.read(spark, at).inputFiles()
    box = (72.0, 12.0, 73.0, 13.0)
    near = snapshots.read_box(spark, at, "lon", "lat", box, 0.016)
    assert len(every) >= 15 and 0 < len(near.inputFiles()) <= len(every) // 4
    want = rows.where("lon between 71.984 and 73.016 and lat between 11.984 and 13.016")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect()))
    assert at.rows == 4000 and at.largest["a"] == pytest.approx(rows.agg(F.max("a")).first()[0])
    high = snapshots.read_box(spark, at, "lon", "lat", (0, 0, 90, 90), above=("a", 8.999))
    assert len(high.inputFiles()) < len(every) and sorted(r["cell"] for r in high.collect()) == sorted(r["cell"] for r in rows.where("a > 8.999").collect())
    assert snapshots.read_box(spark, at, "lon", "lat", (1, 1, 2, 2)).count() == 0


def test_pinned_readers_see_their_version_during_an_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/serving"
    one = snapshots.publish(cells(spark, 300, 1), path, "lon", "lat", "cell", ["a"], token="batch-0", rows_per_file=100)
    pinned = snapshots.read(spark, one)
    before = sorted(map(tuple, pinned.collect()))
    two = snapshots.publish(cells(spark, 200, 2), path, "lon", "lat", "cell", ["a"], token="batch-1", rows_per_file=100)
    assert (one.version, two.version) == (1, 2) and snapshots.snapshot(spark, path) == two and snapshots.snapshot(spark, path, 1) == one
    assert sorted(map(tuple, pinned.collect())) == before and snapshots.read(spark, snapshots.snapshot(spark, path)).count() == 200
    assert snapshots.publish(cells(spark, 9, 3), path, "lon", "lat", "cell", ["a"], token="batch-1") == two  # a replay
    assert snapshots.versions(spark, path) == [1, 2]
    assert snapshots.vacuum(spark, path, 1) == [2] and snapshots.read(spark, two).count() == 200
    with pytest.raises(ValueError, match="version"):
        snapshots.snapshot(spark, path, 1)


def test_two_writers_get_two_versions(spark, tmp_path):
    path, made = f"file://{tmp_path}/serving", []

    def write(seed):
        made.append(snapshots.publish(cells(spark, 50, seed), path, "lon", "lat", "cell", ["a"]).version)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [1, 2, 3]


def test_empty_and_null_places_are_published(spark, tmp_path):
    path = f"file://{tmp_path}/serving"
    none = snapshots.publish(cells(spark, 5).where("false"), path, "lon", "lat", "cell", ["a"])
    assert none.rows == 0 and snapshots.read(spark, none).count() == 0
    assert snapshots.read_box(spark, none, "lon", "lat", (0, 0, 90, 90)).count() == 0
    rows = spark.createDataFrame([(1, None, 2.0, None), (2, 3.0, 4.0, 1.0)], "cell long, lon double, lat double, a double")
    at = snapshots.publish(rows, path, "lon", "lat", "cell", ["a"])
    assert at.rows == 2 and snapshots.read(spark, at).count() == 2 and [r["cell"] for r in snapshots.read_box(spark, at, "lon", "lat", (0, 0, 9, 9)).collect()] == [2]


def cube(spark, tmp_path):
    start = datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(days=d), r, c, float(d * 100 + r * 10 + c)) for d in range(70) for r in range(4) for c in range(5) if (d + r + c) % 3]
    table = spark.createDataFrame(rows, "date date, row int, col int, value double")
    files = cubes.write_cubes(table, f"file://{tmp_path}/cubes", (4, 5), 32, -999.0)
    return rows, files


def test_cubes_come_back_and_filters_reach_the_reader(spark, tmp_path):
    rows, files = cube(spark, tmp_path)
    assert len(files) in (3, 4)
    read = cubes.read_cubes(spark, files, 4, 5, 70.0, 10.0, 0.5, days=8, missing=-999.0)
    want = {(d, 10.0 + r * 0.5, 70.0 + c * 0.5, v) for d, r, c, v in rows}
    assert set(map(tuple, read.where("value is not null").collect())) == want
    some = read.where("date between '2020-02-01' and '2020-02-10' and lat >= 11 and lon < 71 and value is not null and lat in (11.0, 11.5)")
    assert set(map(tuple, some.collect())) == {w for w in want if datetime.date(2020, 2, 1) <= w[0] <= datetime.date(2020, 2, 10) and w[1] >= 11 and w[2] < 71}
    assert some.rdd.getNumPartitions() <= 3 < read.rdd.getNumPartitions()
    assert some.count() < read.count() == 96 * 20 == read.select("lat").count()
    assert read.where("date > '2031-01-01'").count() == 0 and read.where("lat > 80").count() == 0
    assert cubes.read_cubes(spark, [], 4, 5, 70.0, 10.0, 0.5).count() == 0


def test_reader_skips_days_and_latitudes():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull

    options = {"files": json.dumps([{"path": "file:///x", "start": "2020-01-01", "days": 60}]), "rows": "4", "cols": "5", "west": "70", "south": "10", "step": "0.5", "days": "10"}
    reader = cubes._Reader(options)
    left = list(reader.pushFilters([EqualTo(("date",), datetime.date(2020, 1, 25)), GreaterThanOrEqual(("lat",), 11.0), IsNotNull(("value",))]))
    assert left == [IsNotNull(("value",))]
    assert [(s.first, s.last, s.low, s.high) for s in reader.partitions()] == [(24, 24, 2, 3)]


class Service(http.server.BaseHTTPRequestHandler):
    asked = []

    def do_GET(self):
        Service.asked.append(self.path)
        n = sum(p == self.path for p in Service.asked)
        body = json.dumps([{"place": self.path, "asked": n}, {"place": self.path + "b", "asked": n}]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_poll_restarts_without_lost_or_doubled_rows(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = [f"http://127.0.0.1:{server.server_port}/{k}" for k in range(3)]
    out, seen = f"{tmp_path}/rows", []

    def start(fail_at):
        def sink(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/{number}")  # by batch number: a replay replaces
            seen.append(number)
            if number == fail_at:
                raise RuntimeError("the sink breaks after it has written")

        stream = poll_source.poll(spark, urls, f"file://{tmp_path}/store", every=0.4, rounds=3)
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="200 milliseconds").start()

    broken = start(1)
    with pytest.raises(Exception, match="sink breaks"):
        broken.awaitTermination(60)
    again = start(None)
    for _ in range(200):
        again.awaitTermination(0.3)
        if len(Service.asked) >= 9:
            break
    again.processAllAvailable()
    again.stop()
    server.shutdown()
    rows = spark.read.parquet(*[f"{out}/{k}" for k in sorted(set(seen))])
    pairs = sorted((r["request"], json.loads(r["value"])["place"]) for r in rows.collect())
    assert pairs == sorted((k, f"/{k % 3}{b}") for k in range(9) for b in ("", "b"))
    assert len(Service.asked) == 9 and seen.count(1) == 2  # the replayed batch asked nobody again


def test_poll_without_pause_needs_rounds(spark):
    with pytest.raises(ValueError, match="rounds"):
        poll_source.poll(spark, ["file:///x"], "file:///y", every=0)


def test_published_view_of_a_stream_replaces_weeks_once(spark, tmp_path):
    from hexcast.sources import snapshots
    from hexcast.streaming.weekly import published_view

    rows = lambda *r: spark.createDataFrame(list(r), "week int, cell long, lon double, lat double, a double")
    path = f"file://{tmp_path}/view"
    sink = published_view(path, ["week"], "lon", "lat", "cell", ["a"])
    sink(rows((1, 1, 1.0, 1.0, 5.0), (1, 2, 2.0, 2.0, 6.0), (2, 1, 1.0, 1.0, 7.0)), 0)
    pinned = snapshots.snapshot(spark, path)
    for _ in range(2):  # the second time is a replay
        sink(rows((2, 1, 1.0, 1.0, 9.0), (3, 2, 2.0, 2.0, 1.0)), 1)
    assert snapshots.versions(spark, path) == [1, 2]
    see = lambda at: sorted((r["week"], r["cell"], r["a"]) for r in snapshots.read(spark, at).collect())
    assert see(pinned) == [(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)]
    assert see(snapshots.snapshot(spark, path)) == [(1, 1, 5.0), (1, 2, 6.0), (2, 1, 9.0), (3, 2, 1.0)]
