"""Operator 7, n-gram Jaccard join: MinHash bands, then full word-shingle sets.

Band and row counts are chosen for the target recall. Texts of equal words are joined first, so copies
count once. Band hashes are shuffled; texts that share one are candidates, and are compared with the full sets of word
shingles in blocks of BLOCK by BLOCK texts: a block gives link counts and a spanning forest, never its pairs, so a group of
any size spreads over tasks and loses no link.

What is compared together is a connected group of candidates or, where that is less work, each of its band buckets, a pair
counting in the first band that it shares. So chance collisions that join many groups into one cost no more than the
texts that share a bucket, and a large group of near copies, which shares most buckets, is not sent once for each of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import components, key_filter, lean, maybe_with_keys, small_batches, width, written
from hexcast.llm.wordhash import mix, sequence_hashes, shingle_hashes, slices, word_hashes

BLOCK = 512
RECALL = 0.999
MOST_HASHES = 192


def banding(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that reaches the recall."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def band_hashes(shingles: np.ndarray, number: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """MinHash band hashes (texts x bands, uint64) of texts that each have a shingle."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    twist = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(number), bands), np.uint64)
    stops = np.cumsum(number)
    a = 0
    while a < len(number):  # a few texts at a time stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + 32_768)))
        low = int(stops[a] - number[a])
        part = shingles[low : int(stops[b - 1])]
        begins = stops[a:b] - number[a:b] - low
        for k in range(bands * rows):
            least = np.minimum.reduceat(((part ^ twist[k]) * odd[k] >> np.uint64(32)).astype(np.uint32), begins)
            out[a:b, k // rows] = mix(out[a:b, k // rows] + least + np.uint64(k + 1))
        a = b
    return out


def by_buckets(work_of_group: Column, work_of_buckets: Column) -> Column:
    """Whether a group of candidates is compared by buckets; both ways find the same links between texts that share a band."""
    return work_of_buckets < work_of_group


def shared_before(bands: list, band: int) -> np.ndarray:
    """Pairs of texts that share a band before this one."""
    each = np.array([b[:band] for b in bands], np.int64).reshape(len(bands), band)
    out = np.zeros((len(bands), len(bands)), bool)
    for k in range(band):
        out |= each[:, k, None] == each[None, :, k]
    return out


def _links(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, similarity: float, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted) of each set and the least member of its linked group, within sets or across two sides."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    place = np.cumsum(n > 1) - 1
    column, member = place[column[shared]], member[shared]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    common = np.zeros((m, m), np.float32)
    step = 4096
    for c in range(0, int((n > 1).sum()), step):
        a, b = np.searchsorted(column, [c, c + step])
        part = np.zeros((m, step), np.float32)
        part[member[a:b], column[a:b] - c] = 1
        common += part @ part.T
    near = common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-6
    near &= side[:, None] != side[None, :] if side.any() else ~np.eye(m, dtype=bool)
    if skip is not None:
        near &= ~skip
    root = np.arange(m)
    while True:
        least = np.where(near, root[None, :], m).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return near @ weights, root
        root = new


def similar_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, class_id, first, n_links, n_copies) of every row.

    Links join texts whose sets of `size`-word shingles have a Jaccard similarity of at least
    `similarity`; classes are connected by links. class_id is the least doc_id of the class, first marks
    the one text (by doc_id, then text hash) that may stay for it, n_links counts other rows linked to
    this one, n_copies those of them with the same words. row is a hash of the text.

    A text of fewer words is one shingle; texts without words, and null texts, are copies of one another
    and link to nothing else. Repeated rows count as copies; null keys sort first.
    """
    bands, per_band = banding(similarity)

    def sketch(batches):
        task = TaskContext.get().partitionId() << 33
        done = 0
        for batch in slices(batches):
            words, counts = word_hashes(batch["text"].tolist())
            one, two = sequence_hashes(words, counts)
            shingles, number = shingle_hashes(words, counts, size)
            some = np.flatnonzero(number > 0)
            hashes = band_hashes(shingles, number[some], bands, per_band).view(np.int64)
            each = [np.zeros(0, np.int64)] * len(batch)
            for k, h in zip(some.tolist(), hashes, strict=True):
                each[k] = h
            uid = task + done + np.arange(len(batch))
            yield pd.DataFrame({"doc_id": batch["key"], "row": batch["row"], "uid": uid, "one": one.view(np.int64), "two": two.view(np.int64), "bands": each})
            done += len(batch)

    def sets(batches):
        for batch in slices(batches):
            words, counts = word_hashes(batch["text"].tolist())
            shingles, number = shingle_hashes(words, counts, size)
            each = [np.unique(s).tobytes() for s in np.split(shingles, np.cumsum(number)[:-1])]
            yield batch.drop(columns="text").assign(shingles=each)

    def compare(batches):
        held, at = [], None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.unit, r.i, r.j) != at:
                    yield from flush(held)
                    held, at = [], (r.unit, r.i, r.j)
                held.append(r)
        yield from flush(held)

    def flush(rows: list):
        rows = list({r.node: r for r in rows}.values())
        if len(rows) < 2:
            return
        nodes = np.array([r.node for r in rows])
        side = np.array([r.block != r.i for r in rows])
        skip = shared_before([r.bands for r in rows], rows[0].band) if rows[0].band > 0 else None
        links, root = _links([np.frombuffer(r.shingles, np.uint64) for r in rows], np.array([r.weight for r in rows]), side, similarity, skip)
        some = links > 0
        yield pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "root": nodes[root[some]]})

    small_batches(docs.sparkSession)
    n = width(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole).alias("row"), whole.alias("text"))
    # the key goes through Python as text, which keeps 64-bit numbers exact beside nulls
    rows = source.withColumn("key", F.col("key").cast("string")).mapInPandas(lean(sketch), "doc_id string, row long, uid long, one long, two long, bands array<long>")
    rows = written(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")

    # one node for each word sequence
    place = F.struct("doc_id", "row", "uid")
    nodes = rows.groupBy("one", "two").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("weight"), F.min_by("bands", place).alias("bands"))
    nodes = written(nodes.select("one", "two", "p.doc_id", "p.row", F.col("p.uid").alias("node"), "weight", "bands"), "nodes")

    # candidates: nodes that share a band hash, linked through the least node of the band's bucket
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", "band", F.xxhash64("band", "hash").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = written(least, "buckets")
    hits = buckets.join(least.select("bucket", "low"), "bucket").where("node <> low")
    groups = components(hits.select(F.col("node").alias("a"), F.col("low").alias("b")))
    groups = written(groups, "candidates")

    # units of comparison: a group of candidates or, where that is less work, its buckets
    blocks = lambda size: F.ceil(F.col(size) / BLOCK)
    work = least.select(F.col("low").alias("node"), (F.col("n") * blocks("n")).alias("work")).join(groups, "node").groupBy("component").agg(F.sum("work").alias("work"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m")).join(work, "component")
    sizes = sizes.select("component", blocks("m").cast("int").alias("blocks"), by_buckets(F.col("m") * blocks("m"), F.col("work")).alias("split"))
    dealt = written(groups.join(written(sizes, "sizes"), "component"), "dealt")
    whole_groups = dealt.where("not split").select("node", F.col("component").alias("unit"), "blocks", F.lit(-1).alias("band"))
    split = dealt.where("split").select("node")
    in_buckets = buckets.join(split, "node").join(least.select("bucket", blocks("n").cast("int").alias("blocks")), "bucket")
    units = whole_groups.unionByName(in_buckets.select("node", F.col("bucket").alias("unit"), "blocks", "band"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = units.groupBy("node").agg(F.collect_list(F.struct("unit", "blocks", block.alias("block"), "band")).alias("units"))  # at most one for each band
    bands_of = F.when(F.exists("units", lambda u: u["band"] >= 0), F.col("bands")).alias("bands")
    dealt = units.join(nodes.select("node", "doc_id", "row", "weight", "bands"), "node").select("node", "doc_id", "row", "weight", "units", bands_of)
    dealt = written(dealt, "units")
    texts = maybe_with_keys(source, "row", key_filter(dealt, "row"))
    texts = texts.join(dealt, (texts["row"] == dealt["row"]) & texts["key"].eqNullSafe(dealt["doc_id"]))
    unit = "struct<unit: long, blocks: int, block: int, band: int>"
    ready = texts.select("node", "weight", "units", "bands", "text").mapInPandas(lean(sets), f"node long, weight long, units array<{unit}>, bands array<long>, shingles binary")
    ready = ready.select("node", "weight", "bands", "shingles", F.explode("units").alias("u")).select("*", "u.*")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ready = ready.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    ready = ready.select("unit", "i", "j", "block", "band", "node", "weight", "shingles", F.when(F.col("band") > 0, F.col("bands")).alias("bands"))
    ready = ready.repartition(n, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    found = written(ready.mapInPandas(lean(compare), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.drop("bands").join(joined, "node", "left").join(links, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    lowest = classes.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("low"))
    classes = classes.join(written(lowest, "lowest"), "component")
    classes = written(classes.select("one", "two", "low", "weight", F.coalesce("links", F.lit(0)).alias("links")), "classes")

    out = rows.select("doc_id", "row", "one", "two").join(classes, ["one", "two"])
    first = F.struct("doc_id", "row") == F.col("low")
    return out.select(
        "doc_id", "row", F.col("low.doc_id").alias("class_id"), F.coalesce(first, F.lit(True)).alias("first"),
        (F.col("links") + F.col("weight") - 1).alias("n_links"), (F.col("weight") - 1).alias("n_copies"),
    )
