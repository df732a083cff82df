"""Operator 5, document fingerprints: exact digests of canonical texts.

A canonical text is the NFKC form, case-folded, both again until nothing changes, with every run of white
space made one space and none at the ends. Its digest is the 128-bit xxhash; texts of equal digest are
compared byte by byte, and should different canonical texts ever share a digest, a second digest with
another seed is added to the fingerprints of all of them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import key_filter, lean, maybe_with_keys, small_batches, split_by_filter, width, written


def canonical(text: str) -> bytes:
    """Canonical form of a text, as UTF-8; the canonical form of a canonical form is itself."""
    if text.isascii():
        text = text.lower()
    else:  # folding may undo composition and the reverse
        before = None
        while text != before:
            before, text = text, unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def second_digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data, seed=1)


def likeness(a: bytes, b: bytes) -> float:
    """1.0 if two canonical texts have the same fingerprint, else 0.0."""
    return float(digest(a) == digest(b) and a == b)


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    def each(batches):
        for batch in batches:
            forms = [canonical(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["key"], "row": batch["row"], "digest": [digest(f) for f in forms], "second": [second_digest(f) for f in forms]})

    # the key goes through Python as text, which keeps 64-bit numbers exact beside nulls
    rows = _rows(docs, key, text).withColumn("key", F.col("key").cast("string"))
    rows = rows.mapInPandas(lean(each), "doc_id string, row long, digest string, second string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text): row tells apart different texts of one key."""
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole).alias("row"), whole.alias("text"))


def collisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest) of canonical texts whose bytes differ although their digests agree.

    Digests are counted map-side, so a text that a third of the rows share is no hot group. Texts whose
    digest occurs more than once are compared with the bytes of their digest's first text, in a join
    that Spark can split. No collision of 128 bits is expected, so the result is normally empty.
    """
    found = written(_digests(docs, key, text).select("digest", "row"), "digests")
    groups = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    shared = written(groups.where("n > 1").select("digest", "first_row"), "shared-digests")
    suspects = found.join(shared, "digest", "left_semi").select("row").distinct()
    texts = maybe_with_keys(_rows(docs, key, text), "row", key_filter(suspects, "row"))

    def forms(batches):
        for batch in batches:
            each = [canonical(t) for t in batch["text"]]
            yield pd.DataFrame({"digest": [digest(f) for f in each], "row": batch["row"], "form": each})

    bodies = texts.mapInPandas(lean(forms), "digest string, row long, form binary")
    bodies = written(bodies.join(shared, "digest"), "forms")
    first = bodies.where("row = first_row").groupBy("digest").agg(F.min("form").alias("first_form"))
    other = bodies.join(written(first, "first-forms"), "digest").where("form <> first_form")
    return other.select("digest").distinct()


def _told_apart(rows: DataFrame, others: DataFrame, name: str, second: str) -> DataFrame:
    """Add the second digest to the column `name` where its digest stands for different texts."""
    others = others.select(F.col("digest").alias("__digest"))
    clear, maybe = split_by_filter(rows, name, key_filter(others, "__digest"))
    met = maybe.join(others, F.col(name) == F.col("__digest"), "left")
    longer = F.when(F.col("__digest").isNotNull(), F.concat(name, F.lit("-"), second)).otherwise(F.col(name))
    return clear.unionByName(met.withColumn(name, longer).select(*rows.columns))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; texts have equal fingerprints if their canonical bytes agree.

    Null texts count as empty; repeated rows each get a row; an empty table gives none. Whole texts of any
    length are read, a thousand rows at a time.
    """
    others = written(collisions(docs, key, text), "collisions")
    rows = _digests(docs, key, text).select("doc_id", F.col("digest").alias("fingerprint"), "second")
    return _told_apart(written(rows, "digests"), others, "fingerprint", "second").select("doc_id", "fingerprint")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half is the next one's start.

    The last floor(n_chars / 2) code points give way to the first as many (or all) of the next document
    in ascending key order; after the last comes the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (1.0 for equal canonical bytes, else 0.0).

    Null texts count as empty; null keys come first; rows of equal key follow by text hash, and repeated
    rows each get a row and are one another's next; a single row is its own next; an empty table gives no
    rows. The edited texts' fingerprints have a second digest wherever documents of their digest have one.
    """
    import hashlib

    def one(doc_id, row, whole: str, after: str) -> tuple:
        half = len(whole) // 2
        edited = whole[: len(whole) - half] + after[:half]
        own, new, other = canonical(whole), canonical(edited), canonical(after)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(whole), sha, digest(own), digest(new), second_digest(own), second_digest(new), likeness(own, new), likeness(own, other)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, second string, edited_second string, near_edited double, near_next double"
    others = written(collisions(docs, key, text), "collisions")
    out = written(with_next(docs, one, schema, key, text), "edited")
    out = _told_apart(out, others, "fingerprint", "second")
    out = _told_apart(out, others, "edited_fingerprint", "edited_second")
    return out.drop("second", "edited_second")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, class_id, n_copies): class_id is the least doc_id of equal canonical texts."""
    prints = written(fingerprints(docs, key, text), "prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return prints.join(written(classes, "classes"), "fingerprint").select("doc_id", "fingerprint", "class_id", "n_copies")


def with_next(docs: DataFrame, make, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Map each document together with the text of the next one in ascending key order; the result is written.

    make(key, row, text, next_text) gives a tuple of schema, whose first column is the key (text here, long in the result). After
    the last document comes the first; a single document is its own next. Null keys come first, rows of equal key are ordered by
    text hash, equal rows by reading order, so a key that a third of the rows share still spreads over many ranges.
    Documents are dealt to ranges of nearly equal counts, and each text crosses the network once; only the first and last
    document of each range are joined afterwards.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def squeezed(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.assign(text=[squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]])

    def pairs(batches):
        import zstandard

        part = TaskContext.get().partitionId()
        loose = zstandard.ZstdDecompressor()
        held, out = None, []
        edge = lambda r, which: (*[None] * len(names), part, which, r.key, r.row, r.text)
        columns = [*names, "part", "edge", "at_key", "at_row", "at_text"]
        for batch in batches:
            for r in batch.itertuples(index=False):
                whole = loose.decompress(r.text).decode("utf-8", "surrogatepass")
                if held:
                    out.append((*make(held[0].key, held[0].row, held[1], whole), part, None, None, None, None))
                else:
                    out.append(edge(r, "first"))
                held = (r, whole)
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                    out = []
        if held:
            out.append(edge(held[0], "last"))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    def joined(batches):
        import zstandard

        loose = lambda t: zstandard.ZstdDecompressor().decompress(t).decode("utf-8", "surrogatepass")
        for batch in batches:
            rows = [make(r.at_key, r.at_row, loose(r.at_text), loose(r.next_text)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    # the key goes through Python as text, which keeps 64-bit numbers exact beside nulls
    plain = schema.replace("doc_id long", "doc_id string", 1)
    dealt = _rows(docs, key, text).withColumn("tie", F.monotonically_increasing_id()).withColumn("key", F.col("key").cast("string"))
    dealt = dealt.mapInPandas(lean(squeezed), "key string, row long, text binary, tie long").withColumn("number", F.col("key").cast("long"))
    dealt = dealt.repartitionByRange(width(docs.sparkSession), "number", "row", "tie").sortWithinPartitions("number", "row", "tie")
    found = written(dealt.select("key", "row", "text").mapInPandas(lean(pairs), f"{plain}, part int, edge string, at_key string, at_row long, at_text binary"), "pairs")

    parts = sorted(r["part"] for r in found.where("edge = 'first'").select("part").collect())  # one number for each range
    after = F.create_map(*[F.lit(x) for p, q in zip(parts, parts[1:] + parts[:1], strict=True) for x in (p, q)]) if parts else F.lit(None)
    firsts = found.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("at_text").alias("next_text"))
    lasts = found.where("edge = 'last'").select("at_key", "at_row", "at_text", (after[F.col("part")] if parts else F.lit(None).cast("int")).alias("next_part"))
    ends = lasts.join(firsts, "next_part").drop("next_part").mapInPandas(lean(joined), plain)
    return found.where("edge is null").select(*names).unionByName(ends).withColumn("doc_id", F.col("doc_id").cast("long"))
