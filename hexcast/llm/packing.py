"""Operator 4, packing: shortest-pack-first over the length histogram.

Lengths are placed longest first; each length goes to the shortest packs that still have room, and only
counts of packing patterns are kept (Krell et al., 2021). Patterns are then joined back to the pieces by
their rank among the pieces of their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.llm.shared import lean, small_batches, width
from hexcast.llm.wordhash import slices


def token_pieces(
    docs: DataFrame, tokenizer: str, kind: str, end_id: int, size: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token ids of every whole text plus end_id, cut into pieces of at most size ids.

    Returns (doc_id, start, length, doc_tokens, ids); ids are little-endian unsigned 32-bit integers. A
    null text counts as empty and gives one piece with only end_id. Rows with equal keys stay separate.
    """

    def cut(batches):
        from hexcast.llm.textids import token_ids

        coder = token_ids(tokenizer, kind)
        for batch in slices(batches):
            flat, n = coder.encode(batch["text"].tolist())
            flat = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
            n = n + 1
            pieces = -(-n // size)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            length = np.minimum(size, n[doc] - start)
            stop = np.cumsum(length) * 4
            data = flat.tobytes()
            yield pd.DataFrame({
                "doc_id": batch["key"].to_numpy()[doc], "start": start, "length": length, "doc_tokens": n[doc],
                "ids": [data[b - 4 * k : b] for b, k in zip(stop.tolist(), length.tolist(), strict=True)],
            })

    small_batches(docs.sparkSession)
    # the key goes through Python as text, which keeps 64-bit numbers exact beside nulls
    rows = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.mapInPandas(lean(cut), "doc_id string, start long, length long, doc_tokens long, ids binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_histogram(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Shortest-pack-first over a histogram of lengths (1 to size).

    Returns the placements (length, first_rank, n, sequence, offset): the n pieces of this length from
    rank first_rank on go, in order, to the n sequences from sequence on, at this offset. There are at
    most a few rows per length, so the result is bounded by size, not by the data.
    """
    open_packs: dict[int, list[list[int]]] = {}  # room left -> runs of [first sequence, count]
    used, rows = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rooms = [room for room in sorted(open_packs, reverse=True) if room >= length]
        moved: dict[int, list[list[int]]] = {}
        for room in rooms:  # the shortest packs have the most room
            while left and open_packs[room]:
                run = open_packs[room][-1]
                n = min(left, run[1])
                rows.append((length, rank, n, run[0], size - room))
                moved.setdefault(room - length, []).append([run[0], n])
                left, rank = left - n, rank + n
                run[0], run[1] = run[0] + n, run[1] - n
                if not run[1]:
                    open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            if not left:
                break
        # packs just filled may take another piece of the same length; then new packs of as many as fit
        while left:
            room = max((r for r in moved if r >= length), default=None)
            if room is None:
                n = min(left, max(1, -(-left // (size // length))))
                rows.append((length, rank, n, used, 0))
                moved.setdefault(size - length, []).append([used, n])
                used += n
            else:
                run = moved[room].pop()
                if not moved[room]:
                    del moved[room]
                n = min(left, run[1])
                rows.append((length, rank, n, run[0], size - room))
                moved.setdefault(room - length, []).append([run[0], n])
                if run[1] > n:
                    moved.setdefault(room, []).append([run[0] + n, run[1] - n])
            left, rank = left - n, rank + n
        for room, runs in moved.items():
            if room:
                open_packs.setdefault(room, []).extend(runs)
    return pd.DataFrame(rows, columns=["length", "first_rank", "n", "sequence", "offset"])


def pack_lengths(pieces: DataFrame, size: int, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces whose lengths are 1 to size; no piece is dropped.

    Pieces of one length are ranked in the given order within hash buckets, so a length that a third of
    the pieces share is ranked by many tasks. Ties in the order are broken by the partition's reading
    order. Existing columns sequence_id and offset are replaced; an empty table gives no rows. The input
    must give the same rows each time it is read (a written table).
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    histogram = pieces.groupBy(F.col(length).alias("length")).count().collect()  # at most size rows
    plan = pack_histogram({r["length"]: r["count"] for r in histogram}, size)
    by_length = {int(k): (g["first_rank"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for k, g in plan.groupby("length")}

    buckets = 4 * width(spark)
    salted = pieces.select(*kept).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(length).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most size x buckets rows
    bases = salted.groupBy(length, "__bucket").count()
    bases = bases.select(length, "__bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__base"))
    ranked = salted.join(bases, [length, "__bucket"])
    within = Window.partitionBy(length, "__bucket").orderBy(*order)
    ranked = ranked.withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in np.unique(n):
            first, start, at = by_length[int(k)]
            here = np.flatnonzero(n == k)
            row = np.searchsorted(first, r[here], "right") - 1
            sequence[here] = start[row] + r[here] - first[row]
            offset[here] = at[row]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__place", place(F.col(length), F.col("__rank")))
    return placed.select(*kept, F.col("__place.sequence_id"), F.col("__place.offset"))
