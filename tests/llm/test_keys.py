"""Large keys beside nulls, hot keys, and inputs without anything to find."""

import hashlib
import time

import public_tokenizers

from hexcast.llm import fingerprints, packing, pii, tokenfiles
from hexcast.llm.decontaminate import contaminated
from hexcast.llm.jaccard import similar_classes

BIG = 2**53 + 1
ITEM = "benchmark question about seventeen purple elephants walking slowly across frozen northern rivers towards answers"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix purple potions near the old mill and nobody minds at all"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(1)


def test_large_keys_beside_nulls(spark, tmp_path):
    rows = docs(spark, [(BIG, f"{PROSE} {ITEM}"), (None, "a@b.com"), (BIG + 2, f"{PROSE} {ITEM} x"), (-BIG, None), (3, "")])
    ids = {BIG, BIG + 2, -BIG, 3, None}
    bench = spark.createDataFrame([(BIG + 4, ITEM), (None, "nothing like the other words here but long enough")], "item_id long, text string").repartition(1)
    found = contaminated(rows, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(BIG, BIG + 4), (BIG + 2, BIG + 4)}
    pieces = packing.token_pieces(rows, public_tokenizers.path("word_bpe_49k.json"), "word", 2, 4096).collect()
    assert {r["doc_id"] for r in pieces} == ids
    assert {r["doc_id"] for r in fingerprints.fingerprints(rows).collect()} == ids
    assert {r["doc_id"] for r in fingerprints.edited_fingerprints(rows).collect()} == ids
    assert {r["doc_id"]: len(r["base"]) for r in pii.find_pii(rows).collect()} == dict.fromkeys(ids, 0) | {None: 1}
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_classes(rows).collect()}
    assert classes[BIG] == classes[BIG + 2] == (BIG, 1) and set(classes) == ids
    tokenfiles.write_token_files(rows, f"file://{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"), "byte", 0)
    read = tokenfiles.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, -BIG, 3, BIG, BIG + 2]


def test_links_of_large_keys(spark):
    near = [f"{PROSE} {PROSE} and then some more words follow here {k}" for k in ("one", "two", "three")]
    rows = docs(spark, [(None, "other"), *zip([BIG, BIG + 2, BIG + 4], near, strict=True)])
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_classes(rows).collect()}
    assert [found[k] for k in (BIG, BIG + 2, BIG + 4)] == [(BIG, 2)] * 3


def test_decontamination_without_anything_to_find(spark):
    bench = spark.createDataFrame([(1, ITEM), (None, None), (2, ""), (3, "?!")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for texts in ([None, None], ["", " "], ["unknown terms only", "zzz"], []):
        rows = docs(spark, [(k, t) for k, t in enumerate(texts)])
        assert contaminated(rows, bench).collect() == []
        assert contaminated(rows, none).collect() == []
    rows = docs(spark, [(None, ITEM), (1, ITEM), (1, ITEM)])
    again = bench.unionByName(spark.createDataFrame([(None, ITEM), (None, ITEM), (9, "purple elephants")], "item_id long, text string"))
    found = sorted([(r["doc_id"], r["item_id"]) for r in contaminated(rows, again).collect()], key=repr)
    assert found == sorted([(d, i) for d in (None, 1, 1) for i in (1, None, None, 9)], key=repr)


def test_hot_key_has_many_ranges_and_each_next(spark):
    texts = [f"text number {k % 700} of a hot key" for k in range(4000)]
    rows = docs(spark, [(7 if k % 4 else k, t) for k, t in enumerate(texts)])
    schema = "doc_id long, text string, after string"
    found = fingerprints.with_next(rows, lambda k, row, text, after: (k, text, after), schema)
    parts = {r[0]: r[1] for r in found.groupBy("doc_id").count().collect()}
    assert parts[7] == 3000 and sum(parts.values()) == 4000
    ours = found.collect()
    assert sorted(r["text"] for r in ours) == sorted(texts) == sorted(r["after"] for r in ours)
    dealt = found.inputFiles()
    assert len(dealt) >= 4
    edited = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(rows.where("doc_id <> 7")).collect()}
    ids = sorted(k for k in range(0, 4000, 4))
    for k, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(texts[k]) // 2
        want = texts[k][: len(texts[k]) - half] + texts[nxt][:half]
        assert edited[k]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_choice_of_many_spans_is_quick():
    taken = pii.Taken((k * 10, k * 10 + 4) for k in range(50_000))
    began = time.perf_counter()
    for k in range(50_000):
        assert taken.free(k * 10 + 4, k * 10 + 6) and not taken.free(k * 10 + 3, k * 10 + 5)
        taken.take(k * 10 + 4, k * 10 + 6)
    assert time.perf_counter() - began < 5


def test_thresholds_by_kind(spark):
    _, thresholds = pii.fit_selector(spark)
    assert set(thresholds) == set(pii.KINDS) and all(t >= 0.5 for t in thresholds.values())
