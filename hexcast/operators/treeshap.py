"""Exact path-dependent tree contributions (SHAP) of Spark's tree ensembles.

For a leaf, the known-features game is a product over the distinct features of its path: a feature counts
1 or 0 if known (whether the row follows the path), and its share of the training rows if unknown. The
Shapley value of such a product needs only the coefficients of a polynomial with one factor per feature,
so a leaf costs a few array operations for all rows of a batch.
"""

from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

Leaf = tuple[float, list[tuple[int, list[tuple[bool, float]], float]]]


def leaves_of(node, weight: float, path: tuple = ()) -> list[Leaf]:
    """(value, [(feature, [(goes left, threshold)], share)]) of each leaf below a Spark tree node."""
    if node.subtreeDepth() == 0:
        grouped: dict[int, tuple[list, float]] = {}
        for feature, left, threshold, share in path:
            tests, product = grouped.get(feature, ([], 1.0))
            grouped[feature] = ([*tests, (left, threshold)], product * share)
        return [(weight * node.prediction(), [(f, t, s) for f, (t, s) in grouped.items()])]
    feature, threshold, n = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
    out = []
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        out += leaves_of(child, weight, (*path, (feature, left, threshold, child.impurityStats().count() / n)))
    return out


def ensemble_leaves(model) -> list[Leaf]:
    """All leaves of a fitted Spark tree regressor (boosted or forest), with the trees' weights."""
    weights = model.treeWeights
    scale = 1.0 if type(model).__name__.startswith("GBT") else 1.0 / sum(weights)
    return [leaf for tree, w in zip(model.trees, weights, strict=True) for leaf in leaves_of(tree._java_obj.rootNode(), w * scale)]


def contributions(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features contributions, expected value): they add up to the model's prediction."""
    out, expected = np.zeros(x.shape), 0.0
    for value, path in leaves:
        m = len(path)
        shares = [s for _, _, s in path]
        expected += value * float(np.prod(shares))
        known = [np.all([(x[:, f] <= t) == left for left, t in tests], axis=0).astype(float) for f, tests, _ in path]
        weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        for i, (feature, _, share) in enumerate(path):
            poly = [np.ones(len(x))]
            for g in range(m):
                if g != i:
                    poly = [(poly[k] * shares[g] if k < len(poly) else 0) + (poly[k - 1] * known[g] if k else 0) for k in range(len(poly) + 1)]
            out[:, feature] += value * (known[i] - share) * sum(w * c for w, c in zip(weight, poly, strict=True))
    return out, expected


def shap_values(model: PipelineModel, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value): signed contribution of each feature to each row's prediction, in long form.

    rows must hold the features as doubles (see models.with_missing).
    """
    leaves = ensemble_leaves(model.stages[-1])

    def explain(batches):
        for batch in batches:
            values, _ = contributions(leaves, batch[features].to_numpy(float))
            n = len(features)
            long = batch[keys].loc[batch.index.repeat(n)].reset_index(drop=True)
            yield long.assign(feature=np.tile(features, len(batch)), value=values.ravel())[[*keys, "feature", "value"]]

    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", feature string, value double"
    return rows.select(*keys, *features).mapInPandas(explain, schema)
