"""Operator 8, line dedup: runs of lines, removed where they repeat globally.

Built from DataFrame functions only. A run is the shortest sequence of whole lines from a given first line,
or up to a given last line, that is long enough to count: two or more lines of together RUN_CHARS, or one
line of PASSAGE_CHARS or of more than PASSAGE_WORDS words. Every line begins one run and ends one, so the
runs inside a repeated passage cover all its lines, whatever its lines' lengths and whatever surrounds it.

A run is removed wherever an earlier equal one exists; the first in ascending (doc_id, row hash, position)
stays, and so do repeats in the same document that overlap it. Equal hashes of the runs' lines are confirmed
by comparing the bytes with the first occurrence. Parts of a line are never removed.

So every line is a boundary, and content decides where the chunk from it ends. With rarer boundaries, chosen
by a rolling hash, a chunk at either end of a passage holds lines around it, and passages of few lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import key_filter, maybe_with_keys, split_by_filter, written

PASSAGE_CHARS = 160
PASSAGE_WORDS = 50
RUN_CHARS = 80

def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row, however often later expressions name them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _further(lengths: Column, k: Column, back: bool) -> Column:
    """Lines after line k (before it, if back) that its run takes: the fewest that give RUN_CHARS; null if too few.

    Each line has one character at least, its line feed, so RUN_CHARS lines are always enough.
    """
    start = F.greatest(k - RUN_CHARS, F.lit(0)) if back else k + 1
    near = F.slice(lengths, start + 1, F.least(F.lit(RUN_CHARS), k) if back else F.lit(RUN_CHARS))
    near = F.reverse(near) if back else near
    state = lambda chars, n: F.struct(chars.cast("int").alias("chars"), n.cast("int").alias("n"))
    more = lambda s, size: F.when((s["chars"] >= RUN_CHARS) & (s["n"] > 0), s).otherwise(state(s["chars"] + 1 + size, s["n"] + 1))
    far = F.aggregate(near, state(F.get(lengths, k), F.lit(0)), more, lambda s: F.when((s["chars"] >= RUN_CHARS) & (s["n"] > 0), s["n"]))
    following = F.get(lengths, k - 1 if back else k + 1)
    return F.when(F.get(lengths, k) + 1 + following >= RUN_CHARS, F.lit(1)).otherwise(far)


def _with_runs(docs: DataFrame) -> DataFrame:
    """Replace __whole by __lines and __runs: (at, more) of each run, the first line's number and that of further lines.

    A run up to a line is left out where it is the run from its first line, as is nearly always so.
    """
    rows = _once(docs, __lines=_lines(F.col("__whole"))).drop("__whole")
    alone = lambda x: (F.length(x) >= PASSAGE_CHARS) | (F.length(x) > 2 * PASSAGE_WORDS) & (F.regexp_count(x, F.lit(r"\S+")) > PASSAGE_WORDS)
    rows = _once(rows, __sizes=F.transform("__lines", F.length), __alone=F.transform("__lines", alone))
    own = lambda back: lambda size, k: F.when(F.get("__alone", k), F.lit(0)).otherwise(_further(F.col("__sizes"), k, back))
    rows = _once(rows, __after=F.transform("__sizes", own(False)), __ahead=F.transform("__sizes", own(True)))
    run = lambda at, more: F.struct(at.alias("at"), more.alias("more"))
    begun = F.filter(F.transform("__after", lambda n, k: run(k, n)), lambda r: r["more"].isNotNull())
    ended = F.filter(F.transform("__ahead", lambda n, k: run(k - n, n)), lambda r: (r["more"] > 0) & ~F.get("__after", r["at"]).eqNullSafe(r["more"]))
    return rows.select("__key", "__row", "__lines", F.concat(begun, ended).alias("__runs"))


def _run_lines(run: Column) -> Column:
    return F.slice("__lines", run["at"] + 1, run["more"] + 1)


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row for each run: place, hash, text and number of lines less one."""
    each = F.transform("__runs", lambda r: F.struct(F.xxhash64(_run_lines(r)).alias("hash"), r["at"].alias("at"), r["more"].alias("more"), F.array_join(_run_lines(r), "\n").alias("text")))
    # the outer form: for explode, Spark would push a filter with the whole expression to the scan
    rows = _with_runs(docs).select("__key", "__row", F.explode_outer(each).alias("__run")).where("__run is not null")
    place = F.struct("__key", "__row", F.col("__run.at").alias("__pos"))
    return rows.select(place.alias("__place"), F.col("__run.hash").alias("__hash"), F.col("__run.text").alias("__text"), F.col("__run.more").alias("__more"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace text by its lines without globally repeated runs, and add lines_removed (long).

    Every row stays, with its other columns; a text whose lines all repeat becomes empty. Null texts
    stay null with 0 lines removed, empty texts stay empty; null keys sort first. Rows with equal key and
    text are one document: all get the same result. Texts of any length are handled whole, each within one
    row. Existing columns lines_removed are replaced; others may have any name.
    """
    kept = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(F.struct(*kept).alias("__all"), F.col(key).alias("__key"), F.col(text).alias("__whole"))
    rows = rows.withColumn("__row", F.xxhash64("__key", "__whole"))
    cut = rows.where(F.col("__whole").isNotNull()).select("__key", "__row", "__whole")

    every = _with_runs(cut).select(F.explode_outer(F.transform("__runs", lambda r: F.xxhash64(_run_lines(r)))).alias("__hash"))
    counts = every.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    repeated = written(counts.where("__n > 1 and __hash is not null").select("__hash"), "runs")
    texts = maybe_with_keys(_occurrences(cut), "__hash", key_filter(repeated, "__hash"))
    texts = written(texts.join(repeated, "__hash"), "run-texts")
    first = texts.groupBy("__hash").agg(F.min(F.struct("__place", F.col("__text").cast("binary").alias("__bytes"))).alias("__f"))
    first = first.select("__hash", F.col("__f.__place").alias("__first"), F.col("__f.__bytes").alias("__bytes"))
    same = texts.join(written(first, "run-firsts"), "__hash").where("__place <> __first")
    same = same.where(F.col("__text").cast("binary") == F.col("__bytes"))
    own = F.col("__place.__key").eqNullSafe(F.col("__first.__key")) & (F.col("__place.__row") == F.col("__first.__row"))
    same = same.where(~(own & (F.col("__place.__pos") <= F.col("__first.__pos") + F.col("__more")))).select("__place.*", "__more")
    gone = same.groupBy("__key", "__row").agg(F.collect_set(F.struct("__pos", "__more")).alias("__gone"))

    # texts that the filter clears have nothing to lose and stay where they are; the others meet their removals,
    # which are far smaller, so these are hashed instead of sorting the texts
    gone = written(gone, "removals").select(F.col("__key").alias("__key2"), F.col("__row").alias("__row2"), "__gone")
    cleared, maybe = split_by_filter(rows, "__row", key_filter(gone, "__row2"))
    out = maybe.join(gone.hint("shuffle_hash"), (F.col("__row") == F.col("__row2")) & F.col("__key").eqNullSafe(F.col("__key2")), "left")
    out = out.withColumn("__lines", F.when(F.col("__gone").isNotNull(), _lines(F.col("__whole"))))
    numbers = F.flatten(F.transform("__gone", lambda g: F.sequence(g["__pos"], g["__pos"] + g["__more"])))
    out = out.withColumn("__left", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), numbers))
    out = out.withColumn("__left", F.transform("__left", lambda k: F.get(F.col("__lines"), k)))
    removed = F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("long")
    out = out.select("__all", F.coalesce(F.array_join("__left", "\n"), F.col("__whole")).alias("__short"), removed.alias("__removed"))
    out = out.unionByName(cleared.select("__all", F.col("__whole").alias("__short"), F.lit(0).cast("long").alias("__removed")))
    columns = [F.col("__short").alias(text) if c == text else F.col("__all").getField(c).alias(c) for c in kept]
    return out.select(*columns, F.col("__removed").alias("lines_removed"))
