"""Approximate searches against brute force on the small tables, and held-out accuracy."""

import re

from hexcast.llm import queries
from hexcast.llm.decontaminate import ANSWER_SHARE, ANSWER_WORDS, LCS_SHARE, lcs


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination_recall(spark, data):
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    want = set()
    for i, item in items.items():
        own, close = set(item), item[-ANSWER_WORDS:]
        for d, doc in docs.items():
            for at in range(0, max(1, len(doc)), 12):
                near = doc[at : at + len(item) + 36]
                if sum(w in own for w in near) >= LCS_SHARE * len(item) and lcs(item, near) >= LCS_SHARE * len(item) and lcs(close, near) >= ANSWER_SHARE * len(close):
                    want.add((d, i))
                    break
    found = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, data).collect()}
    assert want and len(want & found) >= 0.9 * len(want)
    assert len(found - want) <= 0.1 * len(found)


def test_decontamination_of_frequent_words_without_the_rarest(spark):
    import random
    from collections import Counter

    from hexcast.llm.decontaminate import contaminated

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    texts = [rng.choices(vocabulary, k=70) for _ in range(300)]  # each word in about a tenth of them
    share = Counter(w for t in texts for w in set(t))
    items, want = [], set()
    while len(items) < 40:
        item = rng.sample(vocabulary, 20)
        rare = sorted(item, key=lambda w: share[w])[:5]
        if sum(w in rare for w in item[-ANSWER_WORDS:]) <= 3:
            host = 2 * len(items)
            texts[host][20:20] = [f"new{rng.random()}"[5:] if w in rare else w for w in item]
            want.add((host, len(items)))
            items.append(item)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert len(want & found) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(found)


def test_decontamination_of_many_short_items(spark):
    import random

    from hexcast.llm.decontaminate import contaminated

    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = [rng.choices(vocabulary, k=rng.randrange(8, 11)) for _ in range(2000)]
    texts = [rng.choices(vocabulary, k=120) for _ in range(200)]
    for k, t in enumerate(texts):
        t[50:50] = items[k]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert found >= {(k, k) for k in range(200)} and len(found) <= 220


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows)
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum(b > g for b in bad for g in good) >= 0.85 * len(bad) * len(good)


def test_similarity_join_on_whole_table(spark, data):
    from tests.llm.test_cases import brute_classes

    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want = brute_classes([r["text"] for r in docs])
    found = sorted(queries.op7_jaccard_join(spark, data).collect(), key=lambda r: r["doc_id"])
    assert [(r["class_id"], r["n_links"]) for r in found] == [(docs[c]["doc_id"], n) for c, n in want]


def test_groups_by_buckets_count_each_pair_once(spark, data, monkeypatch):
    """All groups compared by buckets in small blocks, and all whole, give the same links."""
    from hexcast.llm import jaccard

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    chain = [base.replace("seven", f"seven{k // 3}").replace("twelve", f"twelve{k // 5}") + " ".join(f"w{j}" for j in range(k, k + 40)) for k in range(30)]
    docs = docs.unionByName(spark.createDataFrame([(100_000 + k, t) for k, t in enumerate(chain)], "doc_id long, text string"))
    found = []
    for split in (True, False):
        monkeypatch.setattr(jaccard, "BLOCK", 3 if split else 512)
        monkeypatch.setattr(jaccard, "by_buckets", lambda group, buckets, split=split: (group > 0) == split)
        found.append(sorted(map(tuple, jaccard.similar_classes(docs).collect())))
    assert found[0] == found[1] and sum(r[4] > 0 for r in found[0]) > 50


def test_toxicity_precision_recall_and_calibration(spark):
    """On held-out rows only about one in eight is toxic: accuracy alone says little. The smaller tables hold six of them."""
    import numpy as np

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = queries.op3_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    y, p, said = (np.array([r[c] for r in rows], float) for c in ("toxic", "score", "predicted"))
    caught = (y * said).sum()
    assert caught >= 0.8 * y.sum() and caught >= 0.95 * said.sum()
    tenths = np.minimum((p * 10).astype(int), 9)
    error = sum((tenths == k).mean() * abs(p[tenths == k].mean() - y[tenths == k].mean()) for k in range(10) if (tenths == k).any())
    assert error <= 0.05 and ((p >= 0.5) == (said == 1)).all()


def test_decontamination_is_fitted_on_every_item_and_no_sample(spark, data, monkeypatch):
    from hexcast.llm import decontaminate

    tables = []
    kept = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: (tables.append(df.count()), kept(df, name))[1])
    bench = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("cast(row_number() over (order by text) as long) item_id", "concat(text, ' with some more words for a whole item') text")
    queries.contaminated(spark.read.parquet(f"{data}/documents.parquet"), bench)
    assert sum(tables) == bench.count()  # one row for each item; before, tables of sampled documents and their passages too
