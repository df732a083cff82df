"""Regions of adjacent hot cells, week by week: areas, and how regions of one week go over into the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.operators.spatial import RING_1, offsets
from hexcast.session import materialised


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of an undirected graph; component is the least node connected with it.

    Every node takes the least label around it and then that label's own label, which halves the way that is left, so the number of
    rounds grows with the logarithm of the longest chain. Each round is written; only one count reaches the driver: the
    joins are merges, as a broadcast of the labels would pass through the driver in every round.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near")))
    both = materialised(both.distinct())
    labels = materialised(both.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        around = both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("other")).hint("merge"), "near").groupBy("node").agg(F.min("other").alias("other"))
        step = labels.join(around.hint("merge"), "node").select("node", "component", F.least("component", "other").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("beyond"))
        found = materialised(step.join(jump.hint("merge"), "least").select("node", "component", F.least("least", "beyond").alias("next")))
        if not found.where("component <> next").limit(1).count():
            return labels
        labels = found.select("node", F.col("next").alias("component"))


def hot_regions(hot: DataFrame, week: str = "week") -> DataFrame:
    """(week, cell, region): region is the least cell of the hot cells that are connected with it in that week.

    hot has week, cell, q and r, a row for each hot cell and week. Neighbours meet by place in an equi-join; three of the six
    directions are enough. A cell without hot neighbours is a region of its own.
    """
    rows = hot.select(F.col(week).alias("week"), "cell", "q", "r")
    sent = rows.select("week", F.col("cell").alias("near"), "q", "r", offsets(RING_1[::2]).alias("o"))
    sent = sent.select("week", "near", (F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r"))
    pairs = rows.join(sent.hint("merge"), ["week", "q", "r"])
    node = lambda c: F.struct("week", F.col(c).alias("cell"))
    groups = connected(pairs.select(node("cell").alias("a"), node("near").alias("b")))
    named = groups.select("node.week", "node.cell", F.col("component.cell").alias("region"))
    return rows.select("week", "cell").join(named.hint("merge"), ["week", "cell"], "left").withColumn("region", F.coalesce("region", "cell"))


def region_links(regions: DataFrame) -> DataFrame:
    """(week, region, next_region, shared): regions of a week and of the one after it that have cells in common."""
    after = regions.select((F.col("week") - 1).alias("week"), "cell", F.col("region").alias("next_region"))
    return regions.join(after.hint("merge"), ["week", "cell"]).groupBy("week", "region", "next_region").agg(F.count(F.lit(1)).alias("shared"))


def region_events(regions: DataFrame) -> DataFrame:
    """(week, region, cells, came_from, goes_to, event) of every region.

    event: Birth without a region before it; Merge with several; Split if it is one of several that came from the same one; else
    Expanding, Shrinking or Steady by the number of cells against the one it came from. goes_to 0 is its end.
    """
    sizes = regions.groupBy("week", "region").agg(F.count(F.lit(1)).alias("cells"))
    links = materialised(region_links(regions))
    heirs = links.groupBy("week", "region").agg(F.count(F.lit(1)).alias("goes_to"))
    from_ = links.join(heirs.hint("merge"), ["week", "region"]).join(sizes.hint("merge"), ["week", "region"])
    from_ = from_.groupBy((F.col("week") + 1).alias("week"), F.col("next_region").alias("region"))
    from_ = from_.agg(F.count(F.lit(1)).alias("came_from"), F.max("goes_to").alias("siblings"), F.sum("cells").alias("before"))
    rows = sizes.join(from_.hint("merge"), ["week", "region"], "left").join(heirs.hint("merge"), ["week", "region"], "left")
    event = F.when(F.col("came_from").isNull(), "Birth").when(F.col("came_from") > 1, "Merge").when(F.col("siblings") > 1, "Split")
    event = event.when(F.col("cells") > F.col("before"), "Expanding").when(F.col("cells") < F.col("before"), "Shrinking").otherwise("Steady")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("week", "region", "cells", count("came_from"), count("goes_to"), event.alias("event"))
