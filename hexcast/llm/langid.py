"""Operator 13, language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to ORDER bytes with the counts of the bytes that follow. A byte's code length
is found by PPM with method C and full exclusion: the longest known context gives count / (total + distinct),
or an escape of distinct / (total + distinct) to the next shorter one, in which the bytes already ruled out count no longer; below
the empty context, all bytes left are equally likely. Statistics are frozen after learning, so lengths are exact sums over a text, and the
language with the shortest one is predicted.

Counts cover every labelled row: tasks count their byte strings of ORDER + 1, Spark sums them, and shorter contexts are sums of
longer ones. The trees keep their most frequent contexts, CONTEXTS over all languages, so what is broadcast is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexcast.llm.shared import lean, small_batches, written

ORDER = 4
CONTEXTS = 1 << 16  # of all trees together; each has at most 256 bytes
BLOCK = 1 << 20  # bytes looked at together
HELD = 1 << 20  # different strings a task counts before it hands them on
PAD = b"\n" * ORDER  # stands before each text
NATS = np.log(2)


def parts(texts: list[str]):
    """(rows, owners): the lower-cased bytes of the texts, each after ORDER bytes of context, in groups of about BLOCK bytes.

    A longer text gives several rows, each after the last bytes of the one before.
    """
    held, owners, size = [], [], 0
    for k, t in enumerate(texts):
        whole = PAD + t.lower().encode()
        for a in range(0, len(whole) - ORDER, BLOCK):
            held.append(whole[a : a + BLOCK + ORDER])
            owners.append(k)
            size += len(held[-1])
            if size >= BLOCK:
                yield held, np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield held, np.array(owners)


def strings(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string, row number) of each byte after a row's first ORDER: the byte in the lowest place, the ORDER before it above."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    sizes = np.array([len(r) for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    real = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER
    out = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        out[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return out[real], owner[real]


def string_counts(rows: DataFrame) -> DataFrame:
    """(lang, string, n) over the whole texts of rows (lang, text)."""

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        value, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return value, np.bincount(place, np.concatenate([f[1] for f in found])).astype(np.int64)

    def batch_of(lang: str, found: list) -> pa.RecordBatch:
        value, n = merged(found)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value), pa.array(n)], names=["lang", "string", "n"])

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
            for lang, some in frame.groupby("lang"):
                for group, _ in parts(some["text"].tolist()):
                    code, value = pd.factorize(strings(group)[0])
                    held.setdefault(lang, []).append((value, np.bincount(code, minlength=len(value))))
                if sum(len(f[0]) for f in held.get(lang, [])) > HELD:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > HELD // 2:
                        yield batch_of(lang, held.pop(lang))
        for lang, found in held.items():
            yield batch_of(lang, found)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(lean(count), "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def context_trees(counts: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(lang, size, node, n): the kept nodes, a context of `size` bytes and the byte after it.

    A context is kept with all its bytes if it is as frequent as its language's threshold, the least power of 2^(1/8)
    that leaves the language its share of the contexts. A shorter context is never rarer, so the trees are closed.
    """
    low = lambda k: F.col("string").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), low(k).alias("node")) for k in range(ORDER + 1)])).alias("at")
    nodes = counts.select("lang", "n", sizes).groupBy("lang", "at.size", "at.node").agg(F.sum("n").alias("n"))
    nodes = written(nodes.withColumn("context", F.shiftright("node", 8)), "nodes")
    totals = nodes.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"))
    totals = written(totals.withColumn("level", F.floor(F.log2("total") * 8)), "contexts")
    levels = totals.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("many"))  # a few hundred rows a language
    upto = F.sum("many").over(Window.partitionBy("lang").orderBy(F.desc("level")))
    share = contexts / F.lit(max(1, levels.select("lang").distinct().count()))
    least = levels.withColumn("upto", upto).where(F.col("upto") <= share).groupBy("lang").agg(F.min("level").alias("least"))
    kept = totals.join(least, "lang").where("level >= least").select("lang", "size", "context")
    return nodes.join(kept, ["lang", "size", "context"]).select("lang", "size", "node", "n")


class Tree:
    """One language's frozen statistics as sorted arrays by context size."""

    def __init__(self, size: np.ndarray, node: np.ndarray, n: np.ndarray):
        self.node, self.n, self.context, self.total, self.kinds = [], [], [], [], []
        for k in range(ORDER + 1):
            here = np.flatnonzero(size == k)
            here = here[np.argsort(node[here])]
            self.node.append(node[here])
            self.n.append(n[here].astype(np.float64))
            context, first, kinds = np.unique(node[here] >> 8, return_index=True, return_counts=True)
            self.context.append(context)
            self.kinds.append(kinds.astype(np.float64))
            self.total.append(np.add.reduceat(self.n[k], first) if len(first) else np.zeros(0))
        # entered by an escape from a longer context: what is left of the shorter one's total and kinds
        self.left_total, self.left_kinds = [None], [None]
        for k in range(1, ORDER + 1):
            mask = (1 << 8 * k) - 1
            seen = np.searchsorted(self.node[k - 1], self.node[k] & mask)
            first = np.searchsorted(self.node[k] >> 8, self.context[k])
            ruled_out = np.add.reduceat(self.n[k - 1][seen], first) if len(first) else np.zeros(0)
            above = np.searchsorted(self.context[k - 1], self.context[k] & (mask >> 8))
            self.left_total.append(self.total[k - 1][above] - ruled_out if len(first) else np.zeros(0))
            self.left_kinds.append(self.kinds[k - 1][above] - self.kinds[k] if len(first) else np.zeros(0))

    def bits(self, string: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each string after the bytes before it."""
        out = np.zeros(len(string))
        child = np.full(len(string), -1)  # the longer context last escaped from
        todo = np.arange(len(string))
        for k in range(ORDER, -1, -1):
            if not len(self.context[k]):
                continue
            context = string[todo] >> 8 & (1 << 8 * k) - 1
            at = np.minimum(np.searchsorted(self.context[k], context), len(self.context[k]) - 1)
            known = self.context[k][at] == context
            come, here = todo[known], at[known]
            total, kinds = self.total[k][here], self.kinds[k][here]
            if k < ORDER and len(self.context[k + 1]):
                inner = child[come]
                total = np.where(inner < 0, total, self.left_total[k + 1][inner])
                kinds = np.where(inner < 0, kinds, self.left_kinds[k + 1][inner])
            node = string[come] & (1 << 8 * (k + 1)) - 1
            spot = np.minimum(np.searchsorted(self.node[k], node), len(self.node[k]) - 1)
            hit = self.node[k][spot] == node
            all_ = total + kinds
            with np.errstate(divide="ignore", invalid="ignore"):
                found, escape = np.log2(all_ / self.n[k][spot]), np.log2(all_ / kinds)
            out[come] += np.where(hit, found, np.where(kinds > 0, escape, 0.0))  # no new byte here: the escape is certain
            child[come] = here
            done = np.zeros(len(todo), bool)
            done[np.flatnonzero(known)[hit]] = True
            todo = todo[~done]
        seen = len(self.node[0])  # bytes of the empty context; the rest are equally likely
        out[todo] += np.log2(max(1, 256 - seen))
        return out


def fit_languages(rows: DataFrame, contexts: int = CONTEXTS) -> dict[str, Tree]:
    """Trees by language from rows (lang, text); null languages and texts are left out."""
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    kept = written(context_trees(written(string_counts(rows), "strings"), contexts), "trees")
    names = sorted((r["lang"] for r in kept.select("lang").distinct().collect()), key=str.encode)  # no more than contexts
    if not names:
        return {}
    number = (F.array_position(F.lit(names), F.col("lang")) - 1).cast("int")
    found = kept.select(number.alias("lang"), F.col("size").cast("byte").alias("size"), "node", "n").toArrow()  # bounded by contexts
    lang, size, node, n = (found.column(c).to_numpy() for c in ("lang", "size", "node", "n"))
    return {name: Tree(size[here], node[here], n[here]) for k, name in enumerate(names) if len(here := np.flatnonzero(lang == k))}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_language(docs: DataFrame, trees: dict[str, Tree], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits) of every row: the language whose tree codes the whole text in the fewest bits.

    score is that language's share of the probability that all trees together give the text, bits its code length. Ties go to
    the first language by bytes. Null texts and texts without a letter are `und`, score 0 and bits null, and so is every text when
    nothing was learned. Whole texts of any length are coded. Rows with equal or null keys each give their row; keys of any type pass
    unchanged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(key).alias("key"), F.when(has_letter(F.col(text)), F.col(text)).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    names = list(trees)
    model = spark.sparkContext.broadcast(list(trees.values()))  # at most CONTEXTS contexts

    def code_lengths(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(names)))
        for group, owners in parts(texts):
            string, row = strings(group)
            code, value = pd.factorize(string)
            for k, tree in enumerate(model.value):
                out[:, k] += np.bincount(owners[row], tree.bits(value)[code], minlength=len(texts))
        return out

    def score(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = [k for k, t in enumerate(texts) if t and names]
            lang, share, least = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if some:
                bits = code_lengths([texts[k] for k in some])
                best = bits.argmin(1)
                low = bits.min(1)
                part = 1 / np.exp2(low[:, None] - bits).sum(1)
                for j, k in enumerate(some):
                    lang[k], share[k], least[k] = names[best[j]], float(part[j]), float(low[j])
            columns = [batch.column("key"), pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", "bits"])

    return source.mapInArrow(lean(score), f"key {kind}, lang_pred string, score double, bits double").withColumnRenamed("key", key)
