"""Boosted trees grown leaf by leaf from histograms, for several targets at once.

A tree's nodes are histograms of gradients by feature and bin, summed by one aggregation for each depth; of two siblings only the
smaller is summed, and the other is its parent less it. How a node splits does not depend on the order in which nodes are
split, so the best-first choice of up to `leaves` leaves is made over the sums of all depths: the result is that of growing
one leaf at a time, in as many passes over the rows as the tree is deep. All groups (targets, horizons) are summed in the
same pass. What reaches the driver is bounded by groups x nodes of a depth x features x bins, whatever the number of rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcast.session import materialised

KEEP = 1  # trees between two writes of the rows' predictions; the plan holds no more of them


TOGETHER = 10  # trees that one plan evaluates when it predicts


@dataclass
class Shape:
    """How trees grow: number, rate, leaves, depth, rows in a leaf, the two penalties and the bins of a feature."""

    trees: int = 250
    rate: float = 0.06
    leaves: int = 63
    depth: int = 8
    rows: int = 50
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 32


@dataclass
class Node:
    """A node: its value, and for an inner one feature, last bin to the left, and the two below."""

    value: float
    feature: int = -1
    bin: int = -1
    below: list = field(default_factory=list)


def bin_edges(rows: DataFrame, features: list[str], bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """Inner edges of nearly equally filled bins of each feature, by mergeable sketches in one pass."""
    wanted = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), wanted, accuracy).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> Column:
    """The bins of a row as an array of bytes; a value goes right of all edges below it, null counts as 0."""
    one = lambda f, e: F.size(F.filter(F.lit(e).cast("array<double>"), lambda x: x < F.coalesce(F.col(f).cast("double"), F.lit(0.0))))
    return F.array(*[one(f, e).cast("tinyint") for f, e in zip(features, edges, strict=True)])


def _score(g: np.ndarray, n: np.ndarray, shape: Shape) -> np.ndarray:
    """What a node with gradient sum g and n rows gains by its best value."""
    shrunk = np.maximum(np.abs(g) - shape.l1, 0.0)
    return shrunk**2 / (n + shape.l2)


def _value(g: float, n: float, shape: Shape) -> float:
    return float(np.sign(g) * max(abs(g) - shape.l1, 0.0) / (n + shape.l2))


def best_split(hist: np.ndarray, shape: Shape) -> tuple[float, int, int] | None:
    """(gain, feature, last bin to the left) of a histogram (features x bins x (gradient, rows)), or None."""
    left = hist.cumsum(1)[:, :-1]
    whole = hist[0].sum(0)
    right = whole - left
    gain = _score(left[..., 0], left[..., 1], shape) + _score(right[..., 0], right[..., 1], shape) - _score(whole[0], whole[1], shape)
    gain[(left[..., 1] < shape.rows) | (right[..., 1] < shape.rows)] = -np.inf
    gain = np.round(gain, 9)
    at = int(gain.argmax())  # ties: the first feature, then the lowest bin
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain.size and gain[f, b] > 1e-9 else None


def grow_many(ask, groups: list, shape: Shape) -> dict:
    """Trees by group. ask({group: [(feature, bin, side) path, ...]}) sums the histograms of the nodes at those paths."""
    known: dict = {g: {(): h} for g, h in _first(ask, groups).items()}
    splits: dict = {g: {} for g in groups}
    front = {g: [()] for g in groups}
    for _ in range(shape.depth):
        asked, pairs = {}, []
        for g in groups:
            for path in front[g]:
                if path in known[g] and (s := best_split(known[g][path], shape)):
                    splits[g][path] = s
                    left = known[g][path][s[1], : s[2] + 1, 1].sum()
                    small = 0 if left * 2 <= known[g][path][0, :, 1].sum() else 1
                    asked.setdefault(g, []).append((*path, (s[1], s[2], small)))
                    pairs.append((g, path, s, small))
        if not asked:
            break
        found = ask(asked)
        front = {g: [] for g in groups}
        for g, path, s, small in pairs:
            near = (*path, (s[1], s[2], small))
            other = (*path, (s[1], s[2], 1 - small))
            known[g][near] = found[g][near]
            known[g][other] = known[g][path] - found[g][near]
            front[g] += [near, other]
    return {g: _best_first(known[g], splits[g], shape) for g in groups}


def _first(ask, groups: list) -> dict:
    found = ask({g: [()] for g in groups})
    return {g: found[g][()] for g in groups}


def _best_first(known: dict, splits: dict, shape: Shape) -> Node:
    """The tree of the splits that best-first growth takes until it has as many leaves as allowed."""
    node = lambda path: Node(_value(known[path][0, :, 0].sum(), known[path][0, :, 1].sum(), shape))
    root = node(())
    open_ = {(): root}
    for _ in range(shape.leaves - 1):
        ready = [p for p in open_ if p in splits]
        if not ready:
            break
        path = max(ready, key=lambda p: (splits[p][0], [(-f, -b, -s) for f, b, s in p]))
        _, f, b = splits[path]
        at = open_.pop(path)
        at.feature, at.bin = f, b
        for side in (0, 1):
            below = (*path, (f, b, side))
            at.below.append(node(below))
            open_[below] = at.below[side]
    return root


def _flat(tree: Node) -> list[dict]:
    """A tree as a list of nodes, the root first; `below` is the place of the left node, the right one follows it, 0 for a leaf."""
    out, todo = [{}], [(tree, 0)]
    for node, at in todo:
        out[at] = {"f": max(node.feature, 0), "b": node.bin, "below": len(out) if node.below else 0, "v": node.value}
        if node.below:
            todo += [(node.below[0], len(out)), (node.below[1], len(out) + 1)]
            out += [{}, {}]
    return out


def _asked(paths: list[tuple]) -> Node:
    """A tree that leads to the places of paths: a leaf's value is its path's number, -1 where none ends."""
    root = Node(-1.0)
    for k, path in enumerate(paths):
        at = root
        for f, b, side in path:
            if not at.below:
                at.feature, at.bin, at.below = f, b, [Node(-1.0), Node(-1.0)]
            at = at.below[side]
        at.value = float(k)
    return root


def reached(trees: list[Node], group: Column, bins: Column, depth: int) -> Column:
    """The value of the leaf that a row reaches in the tree of its group (a number from 0); null for a null group.

    Trees are one constant of a plan whose code is the same for all trees.
    """
    listed = F.from_json(F.lit(json.dumps([_flat(t) for t in trees])), "array<array<struct<f: int, b: int, below: int, v: double>>>")
    nodes = F.get(listed, group)

    def step(at: Column, _: Column) -> Column:
        node = F.get(nodes, at)
        return F.when(node["below"] == 0, at).otherwise(node["below"] + F.when(F.get(bins, node["f"]) <= node["b"], 0).otherwise(1))

    return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))["v"]


@dataclass
class Boosted:
    """Fitted trees by group, with the features and edges of their bins and each group's start."""

    features: list[str]
    edges: list[list[float]]
    start: dict
    trees: list[dict]
    shape: Shape

    def predict(self, rows: DataFrame, group: str, name: str) -> DataFrame:
        """Add the prediction of each row's group; absent features and nulls count as 0, an unknown group gives null."""
        have = set(rows.columns)
        full = rows.withColumns({f: F.lit(0.0) for f in self.features if f not in have})
        full = full.withColumn("__bins", binned(full, self.features, self.edges)).withColumn("__group", _number(F.col(group), list(self.start)))
        out = full.withColumn(name, F.get(F.lit(list(self.start.values()) or [0.0]), F.col("__group")))
        for k, tree in enumerate(self.trees):
            out = out.withColumn(name, F.col(name) + reached([tree[g] for g in self.start], F.col("__group"), F.col("__bins"), self.shape.depth) * self.shape.rate)
            if k % TOGETHER == TOGETHER - 1 and k + 1 < len(self.trees):
                out = materialised(out)
        return out.select(*rows.columns, name)


def _number(group: Column, names: list) -> Column:
    """The number of a group from 0; null for an unknown one."""
    if not names:
        return F.lit(None).cast("int")
    place = F.array_position(F.lit(names), group)
    return F.when(place > 0, place - 1).cast("int")


def fit(rows: DataFrame, features: list[str], target: str, group: str, shape: Shape | None = None) -> Boosted:
    """Trees for each value of the column `group` by squared error; rows without a target are left out.

    Rows are binned once and written; their predictions so far are written every KEEP trees, so a plan never holds more of them.
    """
    shape = shape or Shape()
    known = rows.where(F.col(target).isNotNull())
    edges = bin_edges(known, features, shape.bins)
    data = materialised(known.select(F.col(group).alias("group"), binned(known, features, edges).alias("bins"), F.col(target).cast("double").alias("y")))
    start = {r["group"]: float(r["m"]) for r in data.groupBy("group").agg(F.avg("y").alias("m")).orderBy("group").collect()}  # a row for each group
    if not start:
        return Boosted(features, edges, {}, [], shape)
    width, names = max(len(e) for e in edges) + 1, list(start)
    data = data.select(_number(F.col("group"), names).alias("group"), "bins", "y")
    data = data.withColumn("pred", F.get(F.lit(list(start.values())), F.col("group")))
    trees: list[dict] = []
    while len(trees) < shape.trees:

        def ask(asked: dict, data=data) -> dict:
            wanted = [_asked(asked.get(g, [])) for g in names]
            node = reached(wanted, F.col("group"), F.col("bins"), shape.depth).cast("int")
            rows = data.select("group", node.alias("node"), (F.col("y") - F.col("pred")).alias("g"), "bins").where("node >= 0")
            cells = rows.select("group", "node", "g", F.posexplode("bins").alias("feature", "bin"))
            sums = cells.groupBy("group", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).collect()
            out = {g: {p: np.zeros((len(features), width, 2)) for p in paths} for g, paths in asked.items()}
            for r in sums:
                g = names[r["group"]]
                out[g][asked[g][r["node"]]][r["feature"], r["bin"]] = (r["g"], r["n"])
            return out

        tree = grow_many(ask, names, shape)
        trees.append(tree)
        data = data.withColumn("pred", F.col("pred") + reached([tree[g] for g in names], F.col("group"), F.col("bins"), shape.depth) * shape.rate)
        if len(trees) % KEEP == 0:
            data = materialised(data)
    return Boosted(features, edges, start, trees, shape)
