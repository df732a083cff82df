"""Operator 2, benchmark decontamination: latent semantic retrieval, then checks for paraphrases.

1. Document frequencies of the benchmark's terms are counted over all documents.
2. A randomised SVD (Halko et al., 2011) of the TF-IDF rows of all items of a block is computed by distributed products; it
   gives each term a latent vector. Documents take part by their frequencies, which come from all of them.
3. Every passage of every document (two adjacent cells of CELL words) is compared by cosine with every item.
4. Candidates around which fewer words than LCS_SHARE of the item are its own cannot pass and go first.
5. Every place where an item's rarest GRAM consecutive words stand is a candidate too, so verbatim copies are
   found exactly, whatever the cosine.
6. Items of fewer than LEAST_WORDS words, which paraphrase checks cannot tell from chance, are found where
   all their words stand in a row.
7. Around each other candidate, the longest common subsequence of words must cover LCS_SHARE of the item, and
   ANSWER_SHARE of its closing words, where a question's answer stands.

The benchmark is the broadcast side. It is taken in blocks of about BLOCK_ITEMS items and BLOCK_WORDS words, each with
a decomposition of its own, and SCAN_BLOCKS blocks are searched in one scan that splits each text into words once; so what is
broadcast stays bounded, and a larger benchmark means more scans of the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcast.llm.shared import lean, small_batches, width, written
from hexcast.llm.wordhash import mix, slices, word_hashes

CELL = 24
RANK = 128
COMMON = 0.2  # terms in a larger share of the documents carry no weight ...
KEEP_TERMS = 5  # ... unless they are among an item's rarest ones
COSINE = 0.4
LCS_SHARE = 0.6
ANSWER_WORDS = 8
ANSWER_SHARE = 0.5
LEAST_WORDS = 8  # shorter items are found as whole phrases only
BLOCK_ITEMS = 250  # few enough for RANK
BLOCK_WORDS = 15_000  # of a block's items together, unless one item is longer
SCAN_BLOCKS = 8
GRAM = 8  # consecutive words, found exactly
PASSAGES = 1024  # compared at a time, so that their vectors stay small


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of a (Hyyrö, 2004)."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := where.get(x, 0):
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Terms:
    """The benchmark's terms and where they occur in texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the words that are terms."""
        at = np.flatnonzero(self.seen[(words >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        hit = self.hashes[term] == words[at]
        return at[hit], term[hit]


def _document_frequencies(texts: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    def count(batches):
        total = np.zeros(len(terms.hashes), np.int64)
        n = 0
        for batch in slices(batches):
            words, counts = word_hashes(batch["text"].tolist(), letters_only=True)
            at, term = terms.find(words)
            doc = np.searchsorted(np.cumsum(counts), at, "right")
            once = np.unique(doc * len(total) + term) % len(total)
            total += np.bincount(once, minlength=len(total))
            n += len(batch)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(total[some], n)})

    rows = texts.mapInPandas(lean(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(terms.hashes)), 0
    for r in rows:  # one for each benchmark term, and the number of documents
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, n


def _svd(rows: DataFrame, terms: int, rank: int, rounds: int = 3, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms x rank) of sparse rows (ids array<int>, weights array<float>).

    Each round multiplies by the matrix and its transpose on the executors; partial products are summed
    by blocks of terms, and only a terms x (rank + 16) matrix reaches the driver.
    """
    block = 1024
    wide = min(terms, rank + 16)
    basis = np.random.default_rng(seed).standard_normal((terms, wide)).astype(np.float32)

    for _ in range(rounds):
        now = basis

        def product(batches, now=now):
            total = np.zeros((terms, wide), np.float32)
            for batch in batches:
                for ids, weights in zip(batch["ids"], batch["weights"], strict=True):
                    ids, w = np.asarray(ids, np.int64), np.asarray(weights, np.float32)
                    total[ids] += w[:, None] * (w @ now[ids])
            for k in range(0, terms, block):
                yield pd.DataFrame({"block": [k], "part": [total[k : k + block].tobytes()]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p, np.float32) for p in parts["part"])
            return pd.DataFrame({"block": parts["block"][:1], "part": [np.asarray(total, np.float32).tobytes()]})

        sums = rows.mapInPandas(lean(product), "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
        parts = [r["part"] for r in sums.orderBy("block").collect()]
        basis, rest = np.linalg.qr(np.frombuffer(b"".join(parts), np.float32).reshape(terms, wide))
        basis, rest = basis.astype(np.float32), np.abs(np.diag(rest))
    return basis[:, :rank][:, rest[:rank] > 1e-5 * rest.max()]  # repeated rows leave directions of rounding errors


def _grams(term: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each run of size neighbours among term numbers."""
    n = max(0, len(term) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total + term[k : k + n].astype(np.uint64) + np.uint64(1))
    return total


def _phrases(short: list[tuple[int, np.ndarray]]):
    """A search for short items, whose words must all stand in a row."""
    terms = Terms(np.concatenate([w for _, w in short]))
    known: dict[int, dict[int, list[int]]] = {}  # by number of words and hash: items
    for k, w in short:
        known.setdefault(len(w), {}).setdefault(int(_grams(terms.find(w)[1], len(w))[0]), []).append(k)

    def search(words, counts):
        places, term = terms.find(words)
        owner = np.searchsorted(np.cumsum(counts), places, "right")
        found = set()
        for size, items in known.items():
            grams = _grams(term, size)
            n = len(grams)
            row = (places[size - 1 :][:n] - places[:n] == size - 1) & (owner[:n] == owner[size - 1 :][:n])
            for g in np.flatnonzero(row & np.isin(grams, np.array(list(items), np.uint64))):
                found.update((int(owner[g]), k) for k in items[int(grams[g])])
        return [(d, k, 1.0, 1.0, 1.0) for d, k in sorted(found)]

    return search


def _cells(words, counts, terms: Terms):
    """(cell of each hit, its term, first cell of each text, the hit's position): cells are CELL words of one text."""
    per_text = -(-counts // CELL)
    base = np.cumsum(per_text) - per_text
    at, term = terms.find(words)
    stops = np.cumsum(counts)
    text = np.searchsorted(stops, at, "right")
    return base[text] + (at - (stops - counts)[text]) // CELL, term, base, at


def _sums(vectors: np.ndarray, term: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each run of terms; a step takes the k-th term of every run that has one."""
    size = ends - begins
    out = np.zeros((len(begins), vectors.shape[1]), np.float32)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[some] += vectors[term[begins[some] + k]]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): one row for each document and item found in it.

    Words are runs of letters and digits, lower-cased. cosine is the best candidate passage's, lcs and
    answer the shares of the item's words and closing words found in order. Null or empty texts and items match
    nothing, nor do items without a word or documents without any term of the benchmark; items of fewer than LEAST_WORDS
    words match as whole phrases only (all three are then 1). Null ids of documents and items stay null, integer ids of 64 bits
    come back exactly. Repeated rows of a document each give their rows, repeated items each their own; ties all stay, as no
    best item is chosen. Texts of any length are searched whole, in slices of about a million characters. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # ids go through Python as text, which keeps 64-bit numbers exact beside nulls
    source = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = benchmark.where(F.length(item_text) > 0).select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    items = items.groupBy("item", "text").agg(F.count(F.lit(1)).alias("times"))
    size = items.agg(F.count(F.lit(1)), F.sum(F.size(F.split("text", " ")))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_WORDS))
    out = spark.createDataFrame([], _FOUND)
    for b in range(0, blocks, SCAN_BLOCKS):
        block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
        part = items.withColumn("block", block).where(F.col("block").between(b, b + SCAN_BLOCKS - 1)).orderBy("block", "item", "text").collect()  # bounded as above
        if found := _search(source, part):
            out = out.unionByName(found)
    return out.select(F.col("doc_id").cast("long"), F.col("item_id").cast("long"), "cosine", "lcs", "answer")


_FOUND = "doc_id string, item_id string, cosine double, lcs double, answer double"


def _search(source: DataFrame, items: list) -> DataFrame | None:
    """One scan of the documents for the items (block, item, text, times) of a few blocks."""
    words, counts = word_hashes([r["text"] for r in items], letters_only=True)
    each = np.split(words, np.cumsum(counts)[:-1]) if len(items) else []
    numbers = [None if r["item"] is None else str(r["item"]) for r in items]
    times = np.array([r["times"] for r in items])
    searches = []
    if known := [k for k, w in enumerate(each) if len(w) >= LEAST_WORDS]:
        terms = Terms(np.concatenate([each[k] for k in known]))
        frequency, n = _document_frequencies(source.select("text"), terms)
        for b in sorted({items[k]["block"] for k in known}):
            block = [(k, each[k]) for k in known if items[k]["block"] == b]
            own = Terms(np.concatenate([w for _, w in block]))
            searches.append(_latent_search(source.sparkSession, block, own, frequency[np.searchsorted(terms.hashes, own.hashes)], n))
    if short := [(k, w) for k, w in enumerate(each) if 0 < len(w) < LEAST_WORDS]:
        searches.append(_phrases(short))
    if not searches:
        return None

    def search(batches):  # sent with its searches, at most SCAN_BLOCKS blocks
        for batch in slices(batches):
            words, counts = word_hashes(batch["text"].tolist(), letters_only=True)
            found = [row for one in searches for row in one(words, counts)]
            if found:
                best = pd.DataFrame(found, columns=["d", "i", "cosine", "lcs", "answer"]).groupby(["d", "i"], as_index=False).max()
                best = best.loc[best.index.repeat(times[best["i"]])]
                best["doc_id"] = batch["key"].to_numpy()[best["d"]]
                best["item_id"] = [numbers[i] for i in best["i"]]
                yield best[["doc_id", "item_id", "cosine", "lcs", "answer"]]

    return source.mapInPandas(lean(search), _FOUND)


def _latent_search(spark: SparkSession, known: list[tuple[int, np.ndarray]], terms: Terms, frequency: np.ndarray, n: int):
    """A search for a block of items (number, words), fitted on all of them."""
    weighty = frequency <= COMMON * n
    for _, w in known:
        own = np.unique(terms.find(w)[1])
        weighty[own[np.argsort(frequency[own], kind="stable")[:KEEP_TERMS]]] = True
    idf = np.where(weighty, np.log((2 + n) / (1 + frequency)), 0.0).astype(np.float32)

    def weighted(ids: np.ndarray) -> tuple[list[int], list[float]]:
        each, tf = np.unique(ids, return_counts=True)
        w = (1 + np.log(tf)) * idf[each]
        return each[w > 0].tolist(), (w[w > 0] / max(1e-9, np.linalg.norm(w))).tolist()

    rows = spark.createDataFrame([weighted(terms.find(w)[1]) for _, w in known], "ids array<int>, weights array<float>")
    rows = written(rows.repartition(min(8, width(spark))), "items")  # of one block
    vectors = _svd(rows, len(terms.hashes), min(RANK, len(terms.hashes), len(known))) * idf[:, None]

    latent = np.stack([vectors[terms.find(w)[1]].sum(0) for _, w in known])
    latent = (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]).astype(np.float32)
    sizes = np.array([len(w) for _, w in known])
    lists = [w.tolist() for _, w in known]
    numbers = [k for k, _ in known]
    member = np.zeros((len(terms.hashes) + 1, len(known)), bool)  # the last row is of words that are no terms
    for i, (_, w) in enumerate(known):
        member[terms.find(w)[1], i] = True
    anchors: dict[int, list[tuple[int, int]]] = {}  # by hash: items, and where in them the gram begins
    for i, (_, w) in enumerate(known):
        own = terms.find(w)[1]
        at = int(np.convolve(np.log((2 + n) / (1 + frequency[own])), np.ones(GRAM), "valid").argmax())
        anchors.setdefault(int(_grams(own[at : at + GRAM])[0]), []).append((i, at))
    anchored = np.array(sorted(anchors), np.uint64)
    reach = np.maximum(CELL, sizes // 2)

    def own_words(number, low, high, i):
        """How many of the words from low to high are item i's, for arrays of them."""
        out = np.zeros(len(i), np.int64)
        wide = int((high - low).max(initial=1))
        step = max(1, (1 << 18) // wide)
        for a in range(0, len(i), step):
            k = slice(a, a + step)
            at = low[k, None] + np.arange(wide)
            inside = at < high[k, None]
            out[k] = (member[number[np.minimum(at, len(number) - 1)], i[k, None]] & inside).sum(1)
        return out

    def check(found, words, d, i, low, high, cosine):
        near = words[low:high].tolist()
        share = lcs(lists[i], near) / sizes[i]
        if share >= LCS_SHARE:
            close = lists[i][-ANSWER_WORDS:]
            answer = lcs(close, near) / len(close)
            if answer >= ANSWER_SHARE:
                found.append((d, i, float(cosine), share, answer))

    def search(words, counts):
        found = []
        stops = np.cumsum(counts)
        cell, term, base, places = _cells(words, counts, terms)
        number = np.full(len(words), len(terms.hashes), np.int32)
        number[places] = term
        owner = np.searchsorted(stops, places, "right")
        grams = _grams(term)
        last = places[GRAM - 1 :][: len(grams)]
        whole = (last - places[: len(grams)] == GRAM - 1) & (owner[: len(grams)] == owner[GRAM - 1 :][: len(grams)])
        spot = np.flatnonzero(whole)
        spot = spot[anchored[np.minimum(np.searchsorted(anchored, grams[spot]), len(anchored) - 1)] == grams[spot]]
        for g in spot:
            d = owner[g]
            for i, offset in anchors[int(grams[g])]:
                start = stops[d] - counts[d]
                low, high = max(start, places[g] - offset - reach[i]), min(stops[d], places[g] - offset + sizes[i] + reach[i])
                there = slice(*np.searchsorted(places, [max(start, places[g] - offset), places[g] - offset + sizes[i]]))
                v = vectors[term[there]].sum(0)
                check(found, words, d, i, low, high, v @ latent[i] / max(1e-9, np.linalg.norm(v)))
        hit = idf[term] > 0
        cell, term = cell[hit], term[hit]
        begins, ends = _runs(cell)
        for a in range(0, len(begins), PASSAGES):
            here = slice(a, a + PASSAGES + 1)  # one cell more, for the last passage
            sums = _sums(vectors, term, begins[here], ends[here])
            at = cell[begins[here]]
            text = np.searchsorted(base, at, "right") - 1
            after = np.zeros(len(at), bool)
            after[:-1] = (at[1:] == at[:-1] + 1) & (text[1:] == text[:-1])
            both = sums.copy()
            both[:-1][after[:-1]] += sums[1:][after[:-1]]
            both, at, text = both[:PASSAGES], at[:PASSAGES], text[:PASSAGES]
            cosine = (both / np.maximum(np.linalg.norm(both, axis=1), 1e-9)[:, None]) @ latent.T
            w, i = np.divmod(np.flatnonzero(cosine >= COSINE), len(known))
            d = text[w]
            first, start = (at[w] - base[d]) * CELL, stops[d] - counts[d]
            low = start + np.maximum(0, first - reach[i])
            high = start + np.minimum(counts[d], first + 2 * CELL + reach[i])
            for k in np.flatnonzero(own_words(number, low, high, i) >= LCS_SHARE * sizes[i]):
                check(found, words, d[k], i[k], low[k], high[k], cosine[w[k], i[k]])
        return [(d, numbers[i], *rest) for d, i, *rest in found]

    return search


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return begins, np.append(begins[1:], len(values))
