"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcast.llm.decontaminate import contaminated
from hexcast.llm.fingerprints import edited_fingerprints
from hexcast.llm.htmltext import extract_text
from hexcast.llm.jaccard import similar_classes
from hexcast.llm.langid import fit_languages, predict_language
from hexcast.llm.linededup import dedup_lines
from hexcast.llm.merkle import merkle_manifest
from hexcast.llm.oracles import ORACLES, SHARDS
from hexcast.llm.packing import pack_lengths, token_pieces
from hexcast.llm.periodic import find_runs
from hexcast.llm.pii import KINDS, find_pii, joined
from hexcast.llm.shared import documents, scratch_dir, written
from hexcast.llm.sharding import balanced_shards
from hexcast.llm.tokenfiles import read_token_files, write_token_files
from hexcast.llm.toxicity import fit_toxicity

SEQUENCE = 4096
END_ID = 2
__all__ = ["ORACLES", "QUERIES"]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    items = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = balanced_shards(items, SHARDS, ["doc_id", "size", "text_crc32"], "size")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0


def toxicity_scorer(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Fitted on the labels of docs that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return fit_toxicity(docs, labels.where(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity_scorer(spark, docs, sf_dir)(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), "word", END_ID, SEQUENCE)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    packed = pack_lengths(pieces, SEQUENCE, ["doc_id", "start"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = similar_classes(documents(spark, sf_dir))
    return classes.select("doc_id", "class_id", "n_links", "n_copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "lines_removed")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), "byte", 0)
    rows = read_token_files(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def id_crc32() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    lowered = {"text": F.translate("text", upper, upper.lower())}
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = merkle_manifest(documents(spark, sf_dir), fields, lowered, id_crc32() % 5 == 0)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def looped_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, the words from a place on repeat; place and period follow from its id."""
    h = id_crc32()
    chosen = docs.select("doc_id", "text", h.alias("h")).where(h % 10 == 0)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = chosen.select("doc_id", words.alias("w"), F.floor(F.col("h") / 10).cast("long").alias("g")).where(F.size("w") > 0)
    split = split.withColumn("a", F.expr("g % size(w)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    looped = F.expr("transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int))))")
    same = docs.where(F.coalesce(h % 10 != 0, F.lit(True)) | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return same.select("doc_id", "text").unionByName(split.select("doc_id", F.array_join(looped, " ").alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(looped_texts(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(id_crc32() % 4 == 2, F.lit(False))
    trees = fit_languages(docs.where(~out).select("lang", "text"))
    found = predict_language(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_sharding": op1_sharding, "op2_decontamination": op2_decontamination, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints, "op6_pii": op6_pii, "op7_jaccard_join": op7_jaccard_join, "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction, "op10_token_files": op10_token_files, "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs, "op13_language": op13_language,
}
