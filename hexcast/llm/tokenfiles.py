"""Operator 10, binary token files: Simple-8b coded ids in ascending key order.

A data set is a folder of Parquet files whose rows are segments of about a million ids. Segment columns:
part and segment (their order is the order of the ids), id_start (ids of earlier segments of the part),
doc_ids and doc_tokens (the segment's documents and their id counts), and the packed ids (see simple8b).
Parquet only frames the binary segments, so Spark's commit protocol makes each file whole or absent.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.llm.shared import lean, small_batches, width
from hexcast.llm.simple8b import pack_ids, unpack_ids

SEGMENT_IDS = 1 << 20
_SEGMENT = (
    "part int, segment int, id_start long, doc_ids array<long>, doc_tokens array<long>, n_ids long, "
    "book binary, escapes binary, offsets binary, words binary"
)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending key order.

    Null texts count as empty (only the end id); a null key comes first; rows with equal keys follow
    in reading order; an empty table writes no segment.
    """

    def encode(batches):
        from hexcast.llm.textids import token_ids

        coder = token_ids(tokenizer, kind)
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        keys, ids, sizes = [], [], []

        def row() -> pd.DataFrame:
            flat, n = np.concatenate(ids), np.concatenate(sizes)
            return pd.DataFrame([{"part": part, "segment": segment, "id_start": start, "doc_ids": list(chain.from_iterable(keys)), "doc_tokens": n, **pack_ids(flat)}])

        for batch in batches:
            flat, n = coder.encode(batch["text"].tolist())
            stops = np.cumsum(n)
            flat = np.insert(flat, stops, end_id)
            held = sum(map(len, ids))
            at = 0
            while at < len(n):  # cut the batch into segments
                reach = np.searchsorted(stops + np.arange(1, len(n) + 1) - (stops[at - 1] + at if at else 0) + held, SEGMENT_IDS) + 1
                to = min(len(n), max(int(reach), at + 1))
                a, b = (stops[at - 1] + at if at else 0), stops[to - 1] + to
                keys.append([None if k is None else int(k) for k in batch["key"].iloc[at:to]])
                ids.append(flat[a:b])
                sizes.append(n[at:to] + 1)
                held += b - a
                at = to
                if held >= SEGMENT_IDS:
                    yield row()
                    start, segment, held = start + held, segment + 1, 0
                    keys, ids, sizes = [], [], []
        if ids:
            yield row()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(width(docs.sparkSession), "key", "tie").sortWithinPartitions("key", "tie")
    # the key goes through Python as text, which keeps 64-bit numbers exact beside nulls
    rows.select(F.col("key").cast("string"), "text").mapInPandas(lean(encode), _SEGMENT).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode a data set: one row per document (doc_id, start, n_tokens, ids).

    start counts the ids of all earlier documents; ids are little-endian unsigned 32-bit integers.
    """

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = unpack_ids(r.n_ids, r.book, r.escapes, r.offsets, r.words).astype("<u4")
                sizes = np.asarray(r.doc_tokens, np.int64)
                stops = np.cumsum(sizes)
                data = ids.tobytes()
                yield pd.DataFrame({
                    "part": r.part,
                    "doc_id": r.doc_ids,
                    "start": r.id_start + stops - sizes,
                    "n_tokens": sizes,
                    "ids": [data[4 * (b - n) : 4 * b] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)],
                })

    small_batches(spark)
    segments = spark.read.schema(_SEGMENT).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written partition: bounded by the partition count
    bases = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    segments = segments.withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    rows = segments.mapInPandas(lean(decode), "part int, doc_id string, start long, n_tokens long, ids binary")
    rows = rows.join(F.broadcast(bases), "part")
    return rows.select(F.col("doc_id").cast("long"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
