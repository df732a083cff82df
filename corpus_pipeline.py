"""The corpus pipeline: stages applied to the documents table, each written and read again.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents;
the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcast.llm.decontaminate import contaminated
from hexcast.llm.jaccard import similar_classes
from hexcast.llm.linededup import dedup_lines
from hexcast.llm.packing import pack_lengths, token_pieces
from hexcast.llm.queries import END_ID, SEQUENCE, toxicity_scorer
from hexcast.llm.shared import documents, forget, scope, without_keys, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer does not call toxic; null and empty texts are scored as empty ones."""
    return toxicity_scorer(spark, docs, sf_dir)(docs).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that an earlier one has; n_chars follows the text."""
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the first by doc_id and text hash.

    Repeated rows of equal id and text count as one document.
    """
    classes = similar_classes(docs)
    rows = docs.withColumn("__row", F.xxhash64(F.coalesce("text", F.lit(""))))
    drop = classes.where(~F.col("first")).select("doc_id", F.col("row").alias("__row"))
    return without_keys(rows, drop, "doc_id", "__row").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, and so do rows with a null doc_id.

    doc_id names a document: if one of several rows of a doc_id holds an item, all of them go.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_keys(docs, found.select("doc_id").where("doc_id is not null"), "doc_id")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the packed sequences; a null text is one end id."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), "word", END_ID, SEQUENCE)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack_lengths(pieces, SEQUENCE, ["doc_id", "start"])


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: no SQL: trained scores, MinHash, latent retrieval and token ids; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with scope():
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
            forget(spark, but=docs)
    return docs
