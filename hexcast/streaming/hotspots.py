"""Hot spots over weeks: duration, first and last detection, label; as a batch and as a stream whose late rows correct what was said.

A cell is hot in a week if its total is above a bound. A row tells for a cell and a week: the total, how many weeks in a row the cell
has been hot, the first and last weeks of detection so far, and a label. Weeks are counted from the Monday of 1969-12-29.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from hexcast.functions.exprs import exact_parts, week_index, week_start

LASTING = 3  # weeks in a row that make a hot spot persistent
SCHEMA = "cell long, week int, total double, hot boolean, weeks int, first_detection int, last_detection int, label string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEK_MS = 7 * 86_400_000
FIRST_MONDAY_MS = -3 * 86_400_000  # 1969-12-29


def evolution(weekly: DataFrame, bound: float, cell: str = "cell", week: str = "week", total: str = "total") -> DataFrame:
    """The rows of SCHEMA for each (cell, week); windows are by cell, so a long history is one cell's own.

    Without a total, `hot` is null and counts as not hot; a row without a week comes after the cell's weeks.
    """
    w = Window.partitionBy("cell").orderBy(F.asc_nulls_last("week"))
    rows = weekly.select(F.col(cell).cast("long").alias("cell"), F.col(week).cast("int").alias("week"), F.col(total).cast("double").alias("total"))
    rows = rows.withColumn("hot", F.col("total") > bound)
    next_to = F.lag("week").over(w) == F.col("week") - 1
    rows = rows.withColumn("before", F.when(next_to, F.lag("total").over(w))).withColumn("was_hot", F.when(next_to, F.lag("hot").over(w)).otherwise(False))
    rows = rows.withColumn("run", F.sum(F.when(F.col("hot") & F.col("was_hot"), 0).otherwise(1)).over(w))
    weeks = F.when(F.col("hot"), F.row_number().over(Window.partitionBy("cell", "run").orderBy("week"))).otherwise(0)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    detected = F.when(F.col("hot"), F.col("week"))
    rows = rows.select("*", weeks.cast("int").alias("weeks"), F.min(detected).over(so_far).alias("first_detection"), F.max(detected).over(so_far).alias("last_detection"))
    label = F.when(F.col("weeks") >= LASTING, "Persistent").when(F.col("hot") & F.col("was_hot") & (F.col("total") > F.col("before")), "Intensifying")
    label = label.when(F.col("hot"), "Emerging").when(F.col("was_hot"), "Diminishing").otherwise("Non-Hotspot")
    return rows.select("cell", "week", "total", "hot", "weeks", "first_detection", "last_detection", label.alias("label"))


class Evolution(StatefulProcessor):
    """One cell's weeks: totals of the weeks that late rows may still change, and what is known of all weeks before them."""

    def __init__(self, bound: float, keep: int):
        self.bound, self.keep = bound, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "week int", "exact decimal(38,6), rest double")
        self.past = handle.getValueState("past", "week int, total double, weeks int, first int, last int")
        self.count = handle.getValueState("count", "revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.past.get()[0] if self.past.exists() else None
        changed = set()
        for part in rows:
            for week, of_week in part.groupby("week"):
                week = int(week)
                if closed is None or week > closed:
                    exact, rest = self.totals.getValue((week,)) if self.totals.containsKey((week,)) else (Decimal(0), 0.0)
                    self.totals.updateValue((week,), (sum(of_week["exact"], exact), rest + float(of_week["rest"].sum())))
                    changed.add(week)
        if changed:
            self.handle.registerTimer(FIRST_MONDAY_MS + (max(changed) + self.keep + 1) * WEEK_MS)
            told = [r for r in self._told() if r[0] >= min(changed)]
            yield self._frame(key, told)

    def _told(self) -> list[tuple]:
        week, total, weeks, first, last = self.past.get() if self.past.exists() else (None, None, 0, None, None)
        out = []
        for (now,), (exact, rest) in sorted((tuple(k), tuple(v)) for k, v in self.totals.iterator()):
            value = float(exact) + rest
            near, was = week is not None and week == now - 1, weeks > 0
            hot = value > self.bound
            rising = near and was and value > total
            weeks = (weeks + 1 if near and was else 1) if hot else 0
            first, last = (now if first is None else first, now) if hot else (first, last)
            label = "Persistent" if weeks >= LASTING else "Intensifying" if hot and rising else "Emerging" if hot else "Diminishing" if near and was else "Non-Hotspot"
            out.append((now, value, hot, weeks, first, last, label))
            week, total = now, value
        return out

    def _frame(self, key, told: list[tuple]) -> pd.DataFrame:
        revision = (self.count.get()[0] if self.count.exists() else 0) + 1
        self.count.update((revision,))
        frame = pd.DataFrame([(key[0], *r, revision) for r in told], columns=["cell", "week", "total", "hot", "weeks", "first_detection", "last_detection", "label", "revision"])
        return frame.astype({"first_detection": "Int32", "last_detection": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold the weeks that no late row can change any more into what is known of the past."""
        edge = (timerValues.getCurrentWatermarkInMs() - FIRST_MONDAY_MS) // WEEK_MS - self.keep
        folded = [r for r in self._told() if r[0] < edge]
        for r in folded:
            self.totals.removeKey((r[0],))
        if folded:
            week, total, _, weeks, first, last, _ = folded[-1]
            self.past.update((week, total, weeks, first, last))
        return iter(())

    def close(self) -> None:
        """Nothing is held outside of the state."""


def evolution_stream(events: DataFrame, bound: float, cell: str, time: str, value: str, late: str = "14 days", keep: int = 4) -> DataFrame:
    """SCHEMA and revision, in update mode: a cell's weeks from the first one that new events changed; the greatest revision holds.

    Events may be `late`; totals of weeks more than `keep` weeks behind the watermark (no less than `late`) are folded by timers, so a
    cell's state stays small however long its history is. Events without a time or cell are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    exact, rest = exact_parts(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    known = F.coalesce(exact, F.lit(0).cast("decimal(18,6)")).alias("exact"), rest.alias("rest")
    rows = events.select(F.col(cell).cast("long").alias("cell"), F.col(time).cast("timestamp").alias("ts"), *known)
    rows = rows.where("cell is not null and ts is not null").withWatermark("ts", late)
    rows = rows.withColumn("week", week_index(week_start("ts")).cast("int"))
    return rows.groupBy("cell").transformWithStateInPandas(Evolution(bound, keep), f"{SCHEMA}, revision long", "Update", "EventTime")


def standing(told: DataFrame) -> DataFrame:
    """What holds of all that the stream told: the greatest revision of each cell and week."""
    rest = [c for c in told.columns if c not in ("cell", "week", "revision")]
    best = told.groupBy("cell", "week").agg(F.max_by(F.struct(*rest), "revision").alias("r"))
    return best.select("cell", "week", "r.*")


def told_into(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over all that has arrived and return what holds; micro-batches go to folders by number, so a replay replaces its own."""
    spark: SparkSession = stream.sparkSession
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/told={number}")
    stream.writeStream.foreachBatch(sink).outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return standing(spark.read.schema(stream.schema).parquet(f"{path}/told=*"))
