"""Operator 11, Merkle dataset manifest: a tree of digests per source and one over the sources.

Rows are numbered within their source (row_number in range partitions, plus what earlier partitions hold), a level
groups nodes by floor(number / FANOUT), and the sorted digests of a group are hashed into the parent. Levels repeat until
each tree has one node. On the way back down every level joins its parents and adds the siblings to the path, so
a row ends with all that is needed to recompute the root from it. A group is at most FANOUT nodes, whatever a source
holds, and each level is written, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.llm.shared import in_order, with_prefix_sums, written

FANOUT = 16


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(leaves: DataFrame) -> DataFrame:
    """Adds tree (long: rows of all earlier groups) and idx (long: place within the group), from 0.

    Groups ascend by name (null first, bytewise), rows within by key, then leaf. No window sees a whole group: only what
    a range partition's first group holds in earlier partitions is carried over.
    """
    placed = with_prefix_sums(in_order(leaves.withColumn("one", F.lit(1)), "name", "key", "leaf"), ["name", "key", "leaf"], "one")
    here = Window.partitionBy("__part", "name")
    placed = placed.withColumn("low", F.min("__row").over(here))
    counts = placed.groupBy("__part", "name").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("name").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for each range partition: only its first group can have begun earlier
    carried = counts.withColumn("carry", F.sum("n").over(earlier)).where("carry > 0").select("__part", F.col("name").alias("name2"), "carry")
    same = (F.col("p.__part") == F.col("c.__part")) & F.col("name").eqNullSafe(F.col("name2"))
    both = placed.alias("p").join(F.broadcast(carried).alias("c"), same, "left")
    tree = F.col("low") - F.coalesce("carry", F.lit(0))
    return both.select("name", "key", "leaf", "changed", tree.alias("tree"), (F.col("__row") - tree).alias("idx"))


def climb(nodes: DataFrame, *payload: str) -> list[DataFrame]:
    """Levels of runs (tree, run, kids, hash), the lowest first; the last holds one run for each tree.

    nodes has tree, idx and hash; kids are structs of idx, hash and the payload. A tree's only node passes unhashed.
    """
    levels = []
    while True:
        run = F.floor(F.col("idx") / F.lit(FANOUT)).cast("long")
        runs = nodes.groupBy("tree", run.alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash", *payload))).alias("kids"))
        only = (F.col("run") == 0) & (F.size("kids") == 1)
        runs = runs.withColumn("hash", F.when(only, F.col("kids")[0]["hash"]).otherwise(digest(F.array_join("kids.hash", ""))))
        levels.append(written(runs, "runs"))
        if not levels[-1].agg(F.max("run")).first()[0]:  # one number
            return levels
        nodes, payload = levels[-1].select("tree", F.col("run").alias("idx"), "hash"), ()


def descend(levels: list[DataFrame], above: DataFrame, *carry: str) -> DataFrame:
    """(tree, idx, hash, payload, path, carry) of the lowest nodes.

    path holds a (left, right) pair of sibling digests for each level up to the root; above gives each tree's (tree, path,
    carry). Joins are by tree and run, so at most FANOUT rows meet a parent.
    """
    runs = levels[-1].join(above, "tree")
    for below in [*levels[-2::-1], None]:
        hashes = F.col("kids.hash")
        left = F.array_join(F.slice(hashes, 1, F.col("pos")), "")
        right = F.array_join(F.slice(hashes, F.col("pos") + 2, FANOUT), "")
        only = (F.col("run") == 0) & (F.size("kids") == 1)
        step = F.when(only, F.col("path")).otherwise(F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path")))
        kids = runs.select("*", F.posexplode("kids").alias("pos", "kid")).select("tree", "kid.*", step.alias("path"), *carry)
        if below is None:
            return kids
        runs = below.join(kids.select("tree", F.col("idx").alias("run"), "path", *carry), ["tree", "run"])


def merkle_manifest(rows: DataFrame, fields: list[str], changed: dict[str, Column] | None = None, tampered: Column | None = None, key: str = "doc_id", group: str = "source") -> DataFrame:
    """(key, leaf, subroot, root, siblings, path, folded_root, verified) of every row.

    A leaf is the digest of the framed fields. Leaves ascend by key within their group, runs of FANOUT become
    their digest until one is left (subroot), and the subroots, ordered by group, likewise give root. path is
    the list of (left, right) sibling digests from the leaf to the root, siblings all of them in that order as one string.
    folded_root is recomputed from path and the row's leaf, or, where `tampered` holds, the leaf with the columns of
    `changed` in place of its own.

    Null keys and groups come first; repeated keys follow by leaf, so equal rows are interchangeable. Null
    and empty fields differ. An empty table has no rows; a single row is its own subroot and root, without siblings.
    Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    leaf = digest(*[framed(F.col(c)) for c in fields])
    other = digest(*[framed((changed or {}).get(c, F.col(c))) for c in fields])
    edited = F.when(F.coalesce(tampered, F.lit(False)), other) if tampered is not None else F.lit(None).cast("string")
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("name"), leaf.alias("leaf"), edited.alias("changed"))
    nodes = numbered(written(leaves, "leaves")).withColumnRenamed("leaf", "hash")
    trees = climb(nodes.drop("name"), "key", "changed")

    # the forest's tops, one for each group, are the leaves of the tree over the groups
    tops = trees[-1].select(F.col("tree").alias("of"), F.lit(1).alias("one"), "hash")
    tops = with_prefix_sums(in_order(tops, "of"), ["of"], "one")
    crown = climb(tops.select(F.lit(0).cast("long").alias("tree"), F.col("__row").alias("idx"), "hash", "of"), "of")
    top = crown[-1].select("hash").first()
    root = F.lit(top["hash"] if top else None).cast("string")  # one digest
    start = spark.createDataFrame([(0, [])], "tree long, path array<struct<left: string, right: string>>")
    above = descend(crown, start).select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"))

    rows = descend(trees, written(above, "subroots"), "subroot")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    fold = F.aggregate("path", F.coalesce("changed", "hash"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))
    rows = rows.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", root.alias("root"), siblings.alias("siblings"), "path", fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
