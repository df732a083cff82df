"""A stored index of places for search by part of a name: postings of three letters, read only for the letters asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcast.functions.exprs import normalised

GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text, with its beginning marked; none for an empty text."""
    marked = F.concat(F.lit("^"), F.lower(text))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (GRAM - 1), F.lit(1)))
    each = F.array_distinct(F.transform(places, lambda i: F.substr(marked, i, F.lit(GRAM))))
    return F.when(F.char_length(text) > 0, each).otherwise(F.array().cast("array<string>"))


def write_index(places: DataFrame, path: str, names: list[str], files: int = 16) -> None:
    """Store places under path: the rows by id, and the postings (gram, place) of the named columns.

    Postings are dealt out and sorted by gram, so that a reader's filter on grams skips all other files and row groups; a gram that a
    third of the places hold is spread over many files, as places are part of the order. Null names have no postings. Ids follow
    the order of all columns, so equal places have ids of their own.
    """
    spark = places.sparkSession
    rows = places.repartitionByRange(files, *places.columns).sortWithinPartitions(*places.columns).withColumn("place", F.monotonically_increasing_id())
    rows.write.parquet(f"{path}/places")
    stored = spark.read.parquet(f"{path}/places")
    held = F.array_distinct(F.flatten(F.array(*[grams(F.coalesce(F.col(c), F.lit(""))) for c in names])))
    postings = stored.select(F.explode(held).alias("gram"), "place")
    postings.repartitionByRange(files, "gram", "place").sortWithinPartitions("gram", "place").write.parquet(f"{path}/postings")


def asked_grams(query: str) -> list[str]:
    """The grams that every name holding the query as a part has; none for fewer letters than a gram."""
    q = normalised(query)
    return sorted({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The places that hold all of the query's grams in one name or another: a few more than those that hold the query.

    Postings of the grams are read, counted by place, and only those places are fetched. A query shorter than a gram
    asks for the places with a gram that begins with it or holds it, by the postings' own sorted grams.
    """
    postings = spark.read.parquet(f"{path}/postings")
    asked = asked_grams(query)
    if asked:
        found = postings.where(F.col("gram").isin(asked)).groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked)).select("place")
    else:
        found = postings.where(F.contains("gram", F.lit(normalised(query)))).select("place").distinct()
    return spark.read.parquet(f"{path}/places").join(found, "place", "left_semi").drop("place")
