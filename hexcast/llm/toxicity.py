"""Operator 3, toxicity: boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words and word stems, how near they stand to the second
person, capitals, punctuation and obfuscation rates. The lexicon is learned from labelled rows: words and
five-letter stems that are far more frequent in toxic than in other documents. Lexicon, trees and
calibration each have labelled rows of their own, so no later step sees features that know its labels.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import lean, small_batches, written

#: Labelled rows that lexicon, trees and calibration are fitted on: a hash sample of about half this of each kind.
FIT_ROWS = 40_000
#: Shares of the labelled rows, in tenths by hash: lexicon, trees; the rest is for calibration.
LEXICON_TENTHS, TREE_TENTHS = 4, 3
LEXICON = 400  # entries kept, at most
STEM = 5
SMOOTH = 0.5
_WORD = re.compile(r"[^\W_]+(?:[*@$!|][^\W_]+)*")
# fixed values: second-person words of the four languages, and signs that stand in for letters
_YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú usted ti tus vosotros".split())
_PLAIN = str.maketrans("013457@$!|", "oleastasil")
N_FEATURES = 16


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def learn_lexicon(labelled: DataFrame, text: str, label: str) -> dict[str, float]:
    """Words and stems with their log odds of document frequency, toxic against other."""

    def terms(batches):
        for batch in batches:
            out, toxic = [], []
            for t, y in zip(batch["text"], batch["label"], strict=True):
                each = set(_words(t))
                each |= {w[:STEM] + "*" for w in each if len(w) >= STEM}
                out += each
                toxic += [int(y)] * len(each)
            counts = pd.DataFrame({"term": out, "toxic": toxic}).groupby(["term", "toxic"]).size().rename("n")
            yield counts.reset_index()

    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label"))
    counts = rows.mapInPandas(lean(terms), "term string, toxic int, n long").groupBy("term")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    sizes = rows.agg(F.sum(F.col("label").cast("double")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = float(sizes["bad"] or 0), float((sizes["n"] or 0) - (sizes["bad"] or 0))
    odds = F.log((F.col("bad") + SMOOTH) / (bad + 1)) - F.log((F.col("good") + SMOOTH) / (good + 1))
    least = max(3.0, 0.002 * bad)
    best = counts.where(F.col("bad") >= least).withColumn("odds", odds).where("odds > 1.5")
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(LEXICON).collect()
    return {r["term"]: r["odds"] for r in best}


def text_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """N_FEATURES numbers of a whole text; all 0 for an empty one."""
    words = _words(text)
    if not words:
        return [0.0] * N_FEATURES
    n, chars = len(words), len(text)
    marks = np.array([lexicon.get(w, 0.0) for w in words])
    stems = np.array([lexicon.get(w[:STEM] + "*", 0.0) if len(w) >= STEM else 0.0 for w in words])
    odd = [k for k, w in enumerate(words) if not w.isalpha() and not w.isdigit()]
    plain = [lexicon.get(words[k].translate(_PLAIN), 0.0) for k in odd]
    hits = np.flatnonzero((marks > 0) | (stems > 0))
    you = np.flatnonzero([w in _YOU for w in words])
    gaps = np.zeros(0)
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        near = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        gaps = 1.0 / (1.0 + near)
    upper = sum(map(str.isupper, text))
    signs = sum(map(text.count, "!?*"))
    return [
        float((marks > 0).sum()), float((marks > 0).mean()), float(marks.sum()), float(marks.max()), float((stems > 0).sum()), float((stems > 0).mean()),
        float(stems.sum()), float(stems.max()), float(gaps.sum()), float(gaps.max() if len(gaps) else 0), upper / chars, signs / chars,
        len(odd) / n, float(sum(plain)), float(np.log1p(n)), float(len(you) / n),
    ]


def with_features(docs: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """Add features (array<double>) from whole texts; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t, lexicon) for t in texts])

    return docs.withColumn("features", each(F.coalesce(F.col(text), F.lit(""))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label"):
    """A function that adds score (double, 0 to 1) and predicted (0 or 1) to documents.

    labels has the key and a 0/1 label; rows with a null label are left out, and a key with both labels
    counts as 1. At most about FIT_ROWS labels are used, half of each kind, by hash and weighted by the share
    left out, so the labelled side of the join is bounded and is broadcast: texts are never shuffled. With
    labels of one kind only (or none), every score is that kind's share.

    Every row gets a score of its own whole text, whatever its length: null and empty texts have the features
    of an empty text, equal texts (and so repeated rows) get equal scores, an empty table gives no rows.
    Existing columns score and predicted are replaced.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("__label"))
    n, bad = known.agg(F.count(F.lit(1)), F.sum("__label")).first()
    bad = bad or 0.0
    if not 0 < bad < n:
        share = bad / n if n else 0.0
        return lambda docs: docs.withColumn("score", F.lit(share)).withColumn("predicted", F.lit(int(share >= 0.5)))
    h = F.xxhash64(F.col(key), F.lit(9))
    kinds = [min(1.0, FIT_ROWS / 2 / size) for size in (n - bad, bad)]  # a rare kind is kept whole
    rate = F.when(F.col("__label") == 1, kinds[1]).otherwise(kinds[0])
    known = known.where(F.pmod(h, F.lit(1_000_000)) < rate * 1_000_000).withColumn("__weight", 1 / rate)
    rows = docs.join(F.broadcast(known), key)
    rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col("__label").alias("label"), F.col("__weight").alias("weight"), F.expr("pmod(xxhash64(`%s`, 9) div 1000000, 10)" % key).alias("tenth"))
    rows = written(rows, "labelled")
    lexicon = learn_lexicon(rows.where(F.col("tenth") < LEXICON_TENTHS), "text", "label")
    later = rows.where(F.col("tenth") >= LEXICON_TENTHS)
    data = written(with_features(later, "text", lexicon).select("features", "label", "weight", "tenth"), "toxic-fit")
    data = data.withColumn("features", array_to_vector("features"))
    fit, held = (data.where(F.expr(f"tenth {sign} {LEXICON_TENTHS + TREE_TENTHS}")) for sign in ("<", ">="))
    if not fit.count() or not held.count():  # too few labels for three parts
        fit = held = data if data.count() else with_features(rows, "text", lexicon).withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, subsamplingRate=0.8, weightCol="weight").fit(fit)
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(raw(held).select("raw", "label", "weight"))

    def score(docs: DataFrame) -> DataFrame:
        kept = [c for c in docs.columns if c not in ("score", "predicted")]
        inner = docs.select(F.struct(*kept).alias("__row"), F.col(text).alias("__text"))
        ready = with_features(inner, "__text", lexicon).withColumn("features", array_to_vector("features"))
        out = curve.transform(raw(ready))
        # a step of the curve holds many scores: the trees' own order within it, without leaving it
        fine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * 0.999 + F.col("raw") * 0.001))
        return out.select("__row.*", fine.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    return score
