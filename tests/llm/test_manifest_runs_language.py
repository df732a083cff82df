"""Operators 11 to 13 against plain Python, and their corner cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hexcast.llm import langid, periodic
from hexcast.llm.merkle import merkle_manifest
from hexcast.llm.oracles import MERKLE, PERIODIC
from hexcast.llm.queries import QUERIES, op11_merkle, op12_periodic_runs, op13_language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tree(nodes):
    """(root, path of (left, right) for each node) of a list of digests."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        ups, unders = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for leaf in under[a + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(sha(*run))
            unders.append([x for u in under[a : a + 16] for x in u])
        nodes, under = ups, unders
    return nodes[0], paths


def plain_manifest(rows):
    rows = [dict(r) | {"leaf": sha(*[framed(r[c]) for c in FIELDS])} for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted([r for r in rows if r["source"] == s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"])) for s in names}
    trees = {s: tree([r["leaf"] for r in g]) for s, g in groups.items()}
    root, crown = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, crown, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            path = path + top
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            at = sha(*[framed(low(r[c]) if c == "text" else r[c]) for c in FIELDS]) if hit else r["leaf"]
            for left, right in path:
                at = sha(left, at, right)
            out.append((r["doc_id"], r["leaf"], trees[s][0], root, sha(*[a + b for a, b in path]), at, at == root))
    return sorted(out, key=repr)


def stored(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def odd_rows():
    rng = random.Random(5)
    rows = [(k, f"Text {k} " + "É" * (k % 4), "en", "hot" if k % 3 else rng.choice(["a", "B", "é", "z9", ""]), k) for k in range(330)]
    rows += [(None, "No ID", None, None, None), (7, None, None, None, 3), (7, "", "en", None, 0), (7, "", "en", None, 0)]
    rows += [(2**53 + 1, "A" * 100_000, "en", "lone", 1), (-4, "Minus", "en", "hot", 2)]
    return rows


def test_manifest_by_brute_force(spark, tmp_path):
    folder = stored(spark, tmp_path, odd_rows(), ["leaf", "hash", "tree", "idx", "name", "key", "path", "root"])
    ours = sorted((tuple(r) for r in op11_merkle(spark, folder).collect()), key=repr)
    assert ours == plain_manifest([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True)) for r in odd_rows()])
    assert {r[-1] for r in ours} == {True, False}


def test_manifest_of_none_and_one(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(empty, FIELDS).collect() == []
    one = merkle_manifest(spark.createDataFrame([(1, "x", None, None, 1)], SCHEMA), FIELDS).collect()
    assert [(r["root"], r["subroot"], r["siblings"], r["verified"]) for r in one] == [(one[0]["leaf"], one[0]["leaf"], "", True)]


# runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def some_words(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        else:
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghijkl") for _ in range(rng.randint(1, 9))]
            words += (unit * 9)[: rng.randint(len(unit), 9 * len(unit))]
    return words


def test_runs_by_brute_force():
    rng = random.Random(1)
    texts = [some_words(rng) for _ in range(3000)]
    texts += [["a"] * k for k in range(12)] + [list("ab" * 50), list("aab" * 40 + "b"), list(("ab" * 4 + "c") * 5)]
    for words in texts:
        assert periodic.periodic_runs(periodic.numbers(words)) == plain_runs(words)


def test_long_texts_cost_little():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 500, 400_000)
    ids[1000:101_000] = np.tile(ids[1000:26_000], 4)
    assert periodic.periodic_runs(ids)[0][2] == 25_000
    assert periodic.periodic_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    top = min(runs, key=lambda r: (-math.floor(10**12 * r[1] / r[2]), r[0], r[2]), default=None)
    top = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *top, sha(*[f"{a},{size},{q}\n" for a, size, q in runs]), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " \t\n".join(some_words(rng)), "en", "s", 1) for k in range(150)]
    rows += [(None, "a " * 9, None, None, None), (151, None, "en", "s", 1), (152, "", "en", "s", 1), (152, " \n ", "en", "s", 1)]
    rows += [(2**53 + 1, "no break space a\x1cb " * 6, "en", "s", 1), (154, "word " * 30_000, "en", "s", 1), (None, None, None, None, None)]
    folder = stored(spark, tmp_path, rows, ["runs", "top", "collapsed", "key", "start", "h", "w"])
    ours = sorted((tuple(r) for r in op12_periodic_runs(spark, folder).collect()), key=repr)
    assert ours == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic.find_runs(empty).collect() == []


@pytest.mark.parametrize(("query", "sql"), [(op11_merkle, MERKLE), (op12_periodic_runs, PERIODIC)])
def test_sql_gives_the_same_rows(spark, data, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, query(spark, data).select(columns).collect()))) == sorted(map(repr, want.fetchall()))


# languages


def plain_bits(counts, text):
    """Code length of a text by recursion over contexts; counts[k] maps (context, byte) to times."""
    row = langid.PAD + text.lower().encode()
    total = 0.0
    for i in range(langid.ORDER, len(row)):
        byte, ruled_out = row[i], set()
        for k in range(langid.ORDER, -1, -1):
            context = row[i - k : i]
            seen = {b: n for b, n in counts[k].get(context, {}).items() if b not in ruled_out}
            if not counts[k].get(context):
                continue
            everything = sum(seen.values()) + len(seen)
            if byte in seen:
                total += math.log2(everything / seen[byte])
                break
            if seen:
                total += math.log2(everything / len(seen))
            ruled_out |= set(seen)
        else:
            total += math.log2(256 - len(ruled_out))
    return total


def test_code_lengths_by_brute_force(spark):
    known = {"x": ["abra cadabra", "abracadabra éa", "", "Z"], "y": ["banana bandana", "bbb nab", "ab"]}
    rows = [(lang, t) for lang, texts in known.items() for t in texts] + [(None, "zzz"), ("x", None)]
    trees = langid.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(trees) == ["x", "y"]
    tests = ["abracadabra", "banana", "q", "née abba", "xyz" * 9, "ABRA", "bbb\n\nab"]
    docs = spark.createDataFrame([(k, t, "c", "d") for k, t in enumerate(tests)], "doc_id long, text string, lang string, score string")
    ours = {r["doc_id"]: r for r in langid.predict_language(docs, trees).collect()}
    counts = {}
    for lang, texts in known.items():
        counts[lang] = [{} for _ in range(langid.ORDER + 1)]
        for t in texts:
            row = langid.PAD + t.lower().encode()
            for i in range(langid.ORDER, len(row)):
                for k in range(langid.ORDER + 1):
                    counts[lang][k].setdefault(row[i - k : i], Counter())[row[i]] += 1
    for k, t in enumerate(tests):
        bits = {lang: plain_bits(c, t) for lang, c in counts.items()}
        best = min(sorted(bits), key=bits.get)
        assert ours[k]["lang_pred"] == best and ours[k]["bits"] == pytest.approx(bits[best], abs=1e-6)
        assert ours[k]["score"] == pytest.approx(1 / sum(2.0 ** (bits[best] - b) for b in bits.values()))


def test_pruned_trees_are_closed_and_bounded(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("lang", "text")
    counts = langid.string_counts(rows.where("lang is not null and text is not null"))
    kept = langid.context_trees(counts, 2000).collect()
    contexts = {(r["lang"], r["size"], r["node"] >> 8) for r in kept}
    assert 500 < len(contexts) <= 2000
    assert all(k == 0 or (lang, k - 1, c & ((1 << 8 * (k - 1)) - 1)) in contexts for lang, k, c in contexts)


def test_held_out_accuracy(spark, data):
    ours = {r["doc_id"]: r for r in op13_language(spark, data).collect()}
    rows = pq.read_table(f"{data}/documents.parquet").to_pylist()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {k for k, r in ours.items() if r["held_out"]} and len(ours) == len(rows)
    assert np.mean([ours[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in ours.values())


def test_language_corner_cases(spark, tmp_path):
    rows = [(k, "der die das und nicht " * 3, "de", "s", 1) for k in range(20)] + [(k, "the of and to in is " * 3, "en", "s", 1) for k in range(20, 40)]
    rows += [(None, "the and of", None, None, None), (41, None, "en", "s", 1), (42, "", "de", "s", 1), (43, "12 34 !?", "en", "s", 1), (2**53 + 1, "nicht die " * 300_000, None, "s", 1), (1, "the in of", "en", "s", 1)]
    folder = stored(spark, tmp_path, rows, ["bits", "key", "score", "string"])
    ours = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in op13_language(spark, folder).where("doc_id is null or doc_id > 40").collect()}
    assert ours == {(None, "en", True), (41, "und", False), (42, "und", False), (43, "und", False), (2**53 + 1, "de", True)}
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit_languages(empty.select("lang", "text")) == {}
    assert [r["lang_pred"] for r in langid.predict_language(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {}).collect()] == ["und"]
    assert set(QUERIES) >= {"op11_merkle", "op12_periodic_runs", "op13_language"}
