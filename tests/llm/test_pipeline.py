"""The pipeline on a small table against plain Python where that is exact."""

import public_tokenizers

import corpus_pipeline
from hexcast.llm.textids import TokenIds
from tests.llm.test_cases import PROSE, brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    item = "benchmark question about seventeen purple elephants walking slowly across frozen northern rivers towards answers"
    passage = "this repeated passage is long enough to be a chunk " * 5
    texts = [PROSE, PROSE, None, "", f"alpha beta gamma {item} delta", f"unique start\n{passage}", f"other start\n{passage}", "moron scum " * 3 + "tree stone"]
    texts += [f"clean text number {k} about tree river stone cloud bread and word{k} thing{k * 7}" for k in range(60)]
    texts += [f"moron scum text number {k} about tree river stone and word{k}" for k in range(60)]
    rows = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int("moron" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = rows, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == rows.columns
    kept = {r["doc_id"]: r["text"] for r in seen["toxicity"]}
    assert all("moron" not in (t or "") for t in kept.values()) and set(range(7)) <= set(kept)
    after = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert set(after) == set(kept) and after[5] == texts[5] and after[6] == "other start"
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"] if r["text"] is not None)
    ids = sorted(after)
    classes = brute_classes([after[k] for k in ids])
    assert {r["doc_id"] for r in seen["near_duplicates"]} == {ids[c] for c, _ in classes}
    assert {r["doc_id"] for r in seen["decontamination"]} == {r["doc_id"] for r in seen["near_duplicates"]} - {4}
    library = TokenIds(public_tokenizers.path("word_bpe_49k.json"), "word").library
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in seen["decontamination"]}
    assert {r["doc_id"]: r["doc_tokens"] for r in seen["packing"]} == want


def test_run_gives_packed_pieces(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
