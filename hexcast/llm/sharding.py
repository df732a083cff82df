"""Operator 1, sharding: contiguous shards of nearly equal byte size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import in_order, with_prefix_sums


def balanced_shards(items: DataFrame, shards: int, order: list[str], size: str) -> DataFrame:
    """Cut items, in ascending order, into contiguous shards at equal byte targets.

    Sizes are summed per range partition, the partition totals give global prefix sums, and an item
    goes to the shard that holds the middle of its byte range; so a shard misses its target by at most
    one item's size at either end. Adds shard (int, from 0) and slot (long, gapless from 0 within the
    shard); existing columns of these names are replaced.

    Null order keys come first; rows equal in all order columns follow in reading order; a null size
    counts 0; an empty table gives no rows; if all sizes are 0, every item is in shard 0. Other columns may
    have any name; an item larger than a shard's share, such as a very long text, still is in one shard.
    """
    items = items.drop("shard", "slot")
    keys = [f"__order{k}" for k in range(len(order))]
    rows = items.select(F.struct("*").alias("__all"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    placed = with_prefix_sums(in_order(rows, *keys), keys, "__size")
    middle = F.col("__before") * 2 + F.col("__size")
    scaled = F.floor(F.try_divide((middle * shards).cast("decimal(38,0)"), F.col("__total") * 2))
    placed = placed.withColumn("shard", F.least(F.coalesce(scaled, F.lit(0)), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    # one row per shard: bounded by the parameter
    out = placed.join(F.broadcast(first), "shard")
    return out.select("__all.*", "shard", (F.col("__row") - F.col("__first")).alias("slot"))
