"""Corner cases of the corpus operators: nulls, empty texts, repeated rows, empty tables, clashing columns."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hexcast.llm import fingerprints as fp
from hexcast.llm import htmltext, packing, pii, simple8b, textids, tokenfiles, toxicity
from hexcast.llm.decontaminate import contaminated, lcs
from hexcast.llm.jaccard import banding, similar_classes
from hexcast.llm.linededup import dedup_lines
from hexcast.llm.queries import ORACLES, QUERIES
from hexcast.llm.shared import components, without_keys
from hexcast.llm.sharding import balanced_shards

SCHEMA = "doc_id long, text string, lang string, size long, shard int, score string, row string, key string, label string"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix purple potions near the old mill and nobody minds at all"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, 7, "s", "r", "k", "l") for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [PROSE, None, "", PROSE, "one", "  \n ", PROSE + " indeed", "Ünïcode\tÉ " * 3]


def test_shards_are_contiguous_and_gapless(spark):
    rows = balanced_shards(docs(spark, ODD, [3, 1, None, 2, 9, 9, 5, 4]), 3, ["doc_id"], "size").collect()
    assert len(rows) == 8 and sorted(r["shard"] for r in rows) == [0, 0, 0, 1, 1, 2, 2, 2] or len({r["shard"] for r in rows}) == 3
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in order] == [None, 1, 2, 3, 4, 5, 9, 9]
    assert balanced_shards(docs(spark, []), 3, ["doc_id"], "size").count() == 0
    zero = docs(spark, ODD).withColumn("size", F.lit(None).cast("long"))
    assert {r["shard"] for r in balanced_shards(zero, 3, ["doc_id"], "size").collect()} == {0}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    ours = QUERIES[name](spark, data)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, ours.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_ids_equal_the_library(name, kind):
    coder = textids.TokenIds(public_tokenizers.path(name), kind)
    texts = [t or "" for t in ODD] + ["it's we'll", "a  b\n\n c \n", "日本 text", "\0x", "İstanbul", "<|endoftext|> x", " " * 50 + "z", "x" * 3000]
    texts += ["x" + chr(c) + "y " + chr(c) * 2 + " " + chr(c) + "\n " + chr(c) + "1" for c in range(0x270)]
    want = [x.ids for x in coder.library.encode_batch(texts, add_special_tokens=False)]
    for size in (1 << 19, 64):  # whole groups, then texts cut into pieces
        coder.GROUP = size
        ids, n = coder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    coder.ENTRIES = 10
    coder._forget()
    assert coder.encode(texts)[0].tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("as_text", [True, False])
@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_equal_a_library_object_of_its_own(name, kind, as_text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)  # as it comes, but for the special tokens' documented switch
    library.encode_special_tokens = as_text
    texts = [t or "" for t in ODD] + [
        "ΟΔΟΣ ΣΑΣ", "ΣΑΣ.", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "it's DON'T 'Ll x''s", "e\u0301 é A\u030a Å", "İstanbul İ", "ǅ ǆ Straße", "1234 ½ ²³ ١٢", "\u200b\ufeff 𝐀𝐁 ﬁ", "x" * 300_000, "\x1c\x1d a\x85b",
    ]
    ids, n = textids.TokenIds(path, kind, as_text).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_unknown_tokenizer_files_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError, match="kind"):
        textids.TokenIds(public_tokenizers.path("word_bpe_49k.json"), "byte")
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        other = json.load(f)
    other["normalizer"] = {"type": "NFKC"}
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="kind"):
        textids.TokenIds(str(tmp_path / "other.json"), "byte")


@pytest.mark.parametrize("query", ["op4_packing", "op10_token_files"])
def test_id_queries_equal_the_library_on_a_table(spark, data, query):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    table = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    name, last = ("word_bpe_49k.json", 2) if query == "op4_packing" else ("byte_bpe_50k.json", 0)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want, at = [], 0
    for r in table:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, last]
        if query == "op4_packing":
            want += [(r["doc_id"], k, len(ids[k : k + 4096]), crc(ids[k : k + 4096]), len(ids)) for k in range(0, len(ids), 4096)]
        else:
            want.append((r["doc_id"], at, len(ids), crc(ids)))
            at += len(ids)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] if query == "op4_packing" else ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in QUERIES[query](spark, data).select(*columns).collect()) == sorted(want)


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [2**60 - 1], rng.integers(0, 2, 5000), rng.integers(0, 2**20, 3000), rng.zipf(1.3, 9000) % 2**31, [0] * 1024 + [7], [1] * 60 + [2**40]):
        v = np.asarray(values, np.uint64)
        words, offsets = simple8b.pack(v)
        assert simple8b.unpack(words, offsets, len(v)).tolist() == v.tolist()
    ids = np.concatenate([rng.integers(0, 50, 2000), rng.integers(0, 50000, 300)]).astype(np.uint32)
    packed = simple8b.pack_ids(ids)
    assert simple8b.unpack_ids(**packed).tolist() == ids.tolist()
    assert len(packed["words"]) < 2 * len(ids)


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs(spark, ODD, [5, 3, 3, 1, None, 8, 7, 6])
    tokenfiles.write_token_files(rows, f"file://{tmp_path}/t", path, "byte", 0)
    back = tokenfiles.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    library = textids.TokenIds(path, "byte").library
    assert [r["doc_id"] for r in back] == [None, 1, 3, 3, 5, 6, 7, 8]
    want = {t or "": [*library.encode(t or "", add_special_tokens=False).ids, 0] for t in ODD}
    at = 0
    for r in back:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids in want.values()
        at += len(ids)
    tokenfiles.write_token_files(docs(spark, []), f"file://{tmp_path}/e", path, "byte", 0)
    assert tokenfiles.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_packing_keeps_every_piece(spark):
    rows = docs(spark, [*ODD, PROSE * 40])
    pieces = packing.token_pieces(rows, public_tokenizers.path("word_bpe_49k.json"), "word", 2, 64)
    pieces = spark.createDataFrame(pieces.collect(), pieces.schema)
    out = packing.pack_lengths(pieces, 64, ["doc_id", "start"]).collect()
    assert len(out) == pieces.count() and sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
    for s in {r["sequence_id"] for r in out}:
        at = 0
        for r in sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_lengths(pieces.limit(0), 64, ["doc_id", "start"]).count() == 0


def test_histogram_packing_places_each_length():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 33, 12)}
        plan = packing.pack_histogram(counts, 32)
        assert plan.groupby("length")["n"].sum().to_dict() == counts
        used: dict[int, list] = {}
        for r in plan.itertuples():
            for k in range(r.n):
                used.setdefault(r.sequence + k, []).append((r.offset, r.length))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 32
        assert sorted(used) == list(range(len(used)))


def test_fingerprints_fold_case_space_and_forms(spark):
    texts = ["Ａ  b\n", "a B", None, "", "a c", "A b "]
    prints = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs(spark, texts)).collect()}
    assert prints[0] == prints[1] == prints[5] and prints[2] == prints[3] and len(set(prints.values())) == 3
    groups = {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in fp.exact_groups(docs(spark, texts)).collect()}
    assert groups[5] == (0, 3) and groups[4] == (4, 1)
    assert fp.fingerprints(docs(spark, [])).count() == 0


@pytest.mark.parametrize("texts", [ODD, ["only one"], []])
def test_edited_texts_take_from_the_next(spark, texts):
    import hashlib

    rows = fp.edited_fingerprints(docs(spark, texts, [2 * k for k in range(len(texts))])).collect()
    whole = [t or "" for t in texts]
    assert len(rows) == len(texts)
    for r in rows:
        k = r["doc_id"] // 2
        t, n = whole[k], whole[(k + 1) % len(whole)]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(fp.canonical(edited) == fp.canonical(t)) and r["near_next"] == float(fp.canonical(n) == fp.canonical(t))


def test_canonical_forms_are_closed():
    marks = ["", "a", "\u0301", "\u0345", "\u0327"]
    for c in range(0x30000):
        if not 0xD800 <= c < 0xE000:
            for m in marks if c < 0x2000 else marks[:2]:
                form = fp.canonical(chr(c) + m)
                assert fp.canonical(form.decode()) == form
    assert fp.canonical("ß\u0301") == fp.canonical("sś")


def test_colliding_digests_get_a_second_one(spark, monkeypatch, tmp_path):
    """Digests of two hexadecimal digits collide; fingerprints still tell texts apart."""
    import subprocess
    import sys

    script = """
import sys
sys.path.insert(0, %r)
from hexcast.session import session
import hexcast.llm.fingerprints as fp
def digest(data):
    import xxhash
    return xxhash.xxh3_128_hexdigest(data)[:1]
fp.digest = digest
from pyspark import cloudpickle
cloudpickle.register_pickle_by_value(fp)
s = session("local[2]", "collisions", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__checkpoint__dir="file://%s")
texts = [f"{k %% 50} text" for k in range(60)]
rows = fp.edited_fingerprints(s.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
prints = {r["doc_id"]: r["fingerprint"] for r in rows}
assert len(set(prints.values())) == 50 and all(prints[k] == prints[k + 50] for k in range(10))
assert len({r["edited_fingerprint"] for r in rows}) > 16
print("told apart")
""" % (sys.path[0], tmp_path)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=200)
    assert "told apart" in done.stdout, done.stderr[-2000:]


def test_line_dedup_against_brute_force(spark):
    passage = "A passage of many words that is long enough to stand alone as a chunk of its own, " * 3
    texts = [f"first\n{passage}\nlast", f"other {PROSE}\n{passage}\nend", None, "", passage, "short\nlines\nonly", "short\nlines\nonly", f"x\n{passage}", f"x\n{passage}"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 7]
    rows = {(r["doc_id"], k): (r["text"], r["lines_removed"]) for k, r in enumerate(dedup_lines(docs(spark, texts, ids)).orderBy("doc_id").collect())}
    assert rows[0, 0] == (texts[0], 0) and rows[1, 1] == (f"other {PROSE}\nend", 1)
    assert rows[2, 2] == (None, 0) and rows[3, 3] == ("", 0) and rows[4, 4] == ("", 1) and rows[5, 5][1] == rows[6, 6][1] == 0
    assert rows[7, 7] == rows[7, 8] == ("x", 1)
    assert dedup_lines(docs(spark, [])).count() == 0 and "lines_removed" in dedup_lines(docs(spark, ["a"]).withColumn("lines_removed", F.lit(9))).columns


def test_line_dedup_of_short_lines_in_other_surroundings(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    around = lambda: [line(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 6))]
    texts, want = [], []
    for n, size in [(3, 18), (4, 14), (5, 11), (6, 10), (8, 7), (10, 10), (10, 6), (1, 60)] * 5:
        passage = [line(size) for _ in range(n)]
        for k in range(3):
            before, after = around(), around()
            texts.append("\n".join(before + passage + after))
            want.append((texts[-1], 0) if k == 0 else ("\n".join(before + after), n))
    uneven = [line(20), line(15), "", line(2), line(9), line(1), line(8), line(3)]
    tiny = " ".join("a" * 51)  # 101 characters
    texts += ["\n".join(["p", *uneven, "q"]), "\n".join(["r", "s", *uneven]), f"t\n{tiny}", f"{tiny}\nu", "\n".join(["echo echo"] * 30)]
    want += [(texts[-5], 0), ("r\ns", 8), (texts[-2 - 1], 0), ("u", 1), ("\n".join(["echo echo"] * 9), 21)]
    found = dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["text"], r["lines_removed"]) for r in found] == want


def test_line_dedup_has_no_python(spark):
    plan = dedup_lines(docs(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "").lower().split() == (texts[b] or "").lower().split()
            if same or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return list(zip(root, links, strict=True))


def test_jaccard_classes_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = list(ODD)
    for _ in range(6):
        base = [word() for _ in range(80)]
        for _ in range(12):
            edited = list(base)
            edited[rng.randrange(80)] = word()
            texts.append(" ".join(edited))
    texts += [texts[-1], texts[-1].upper(), "a b c", "A  b c"]
    monkeypatch.setattr("hexcast.llm.jaccard.BLOCK", 5)  # several blocks for each group
    rows = sorted(similar_classes(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert [(r["class_id"], r["n_links"]) for r in rows] == brute_classes(texts)
    assert sum(r["first"] for r in rows) == len({r["class_id"] for r in rows})
    assert similar_classes(docs(spark, [])).count() == 0


def test_banding_reaches_the_recall():
    bands, rows = banding(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 192


def test_components(spark):
    import random

    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {k: v for k, v in root.items() if k in found} and all(root[k] == k for k in root if k not in found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_keys(spark):
    rows = docs(spark, ODD, [None, 1, 2, 3, 4, 5, 6, 7])
    assert sorted(r["doc_id"] or -1 for r in without_keys(rows, rows.where("doc_id > 4").select("doc_id"), "doc_id").collect()) == [-1, 1, 2, 3, 4]


def test_lcs():
    assert lcs([1, 2, 3, 4], [2, 9, 4, 1]) == 2 and lcs([], [1]) == 0 and lcs([1], []) == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(12)] + [["too", "short"]]
    texts, want = [], set()
    for k in range(40):
        body = [word() for _ in range(rng.randrange(10, 300))]
        if k % 2 == 0:
            i = rng.randrange(12)
            inside = [w for w in items[i] if k % 4 or rng.random() < 0.85]  # every other one with words left out
            at = rng.randrange(len(body))
            body[at:at] = inside
            want.add((k, i))
        texts.append(" ".join(body))
    texts += [None, "", "too short", "short too, too. Short", "short"]
    want |= {(42, 12), (43, 12)}  # short items: whole phrases
    bench = spark.createDataFrame([(i, " ".join(w).title() + ".") for i, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, texts), bench).collect()}
    assert found == want
    assert contaminated(docs(spark, []), bench).count() == 0 and contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_toxicity_learns_and_keeps_rows(spark):
    import random

    rng = random.Random(7)
    plain = lambda n: [rng.choice(["tree", "river", "stone", "cloud", "bread", "you"]) for _ in range(n)]
    texts, labels = [], []
    for k in range(400):
        words = plain(30)
        if k % 4 == 0:
            words[10] = rng.choice(["moronish", "moronly", "scumbag"])
        texts.append(" ".join(words))
        labels.append((k, int(k % 4 == 0)))
    labels += [(1, None), (0, 1)]
    rows = docs(spark, [*texts, None, ""])
    scorer = toxicity.fit_toxicity(rows, spark.createDataFrame(labels, "doc_id long, label int"))
    out = scorer(rows).collect()
    assert len(out) == 402 and all(0 <= r["score"] <= 1 for r in out)
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out if r["doc_id"] < 400)
    assert right >= 390
    none = toxicity.fit_toxicity(rows, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in none(rows).collect()} == {0.0}


def test_pii_base_and_added_spans(spark):
    text = "Mail a.b@x-y.org or call +1 (212) 555-0100, host 10.0.0.256 or 10.0.0.25; card 4111 1111 1111 1111 bad 4111111111111112"
    base = [(text[a:b], k) for a, b, k in pii.base_spans(text)]
    assert base == [("a.b@x-y.org", "email"), ("+1 (212) 555-0100", "phone"), ("10.0.0.25", "ip"), ("4111 1111 1111 1111", "card")]
    assert pii.base_spans("") == [] and pii.base_spans("@@ a@b @x.com a@b.c@d.e") == [(14, 19, "email")]
    rows = pii.find_pii(docs(spark, [text, None, "", "call me on 212-555-0199 today, version 1.2.3"])).collect()
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows}
    assert found[1] == found[2] == []
    assert [s for s in found[0] if s[0] == "card"] and len(found[0]) >= 4
    assert ("phone", 11, 23) in found[3]
    assert pii.find_pii(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x a.b@c.d-e.f. y", "1.2.3.4.5.6.7.8", "+1+22 333-4444 555 6", "4111-1111-1111-1111 2", "a@@b.c", "é@x.y", "..@a.b", "5 5 5 5" * 9])
def test_base_spans_equal_the_plain_patterns(text):
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    want = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                want.append((m.start(), m.end(), kind))
    assert sorted(pii.base_spans(text)) == sorted(want)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b>text &nbsp; here<br>next.<p>Second paragraph with quite some words in it, so that it reads like an article.</p>
<div class="ad">Buy!</div><ul><li>one<li>two</ul></article><section id="comments"><p>Nice post, I liked it a lot and I will read it again tomorrow with my friends.</p></section></main><form><button>Go</button></form><footer>&copy; x</footer><script>var a="</p>";</script></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Title & more\n\nFirst boldtext here next.\n\nSecond paragraph with quite some words in it, so that it reads like an article.\n\none\n\ntwo"
    for page in ("", "plain", "<", "<p", "<p>x", "<!-- a", "<div " + "a" * 5000, "<b>" * 3000, "<article><p>unclosed", "<a href='x>y'>z</a>"):
        htmltext.main_text(page)


def test_min_cut_against_all_labellings():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(40):
        n = 6
        scores = rng.integers(-5, 6, n).astype(float).tolist()
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 8), rng.integers(0, n, 8), rng.integers(1, 4, 8), strict=True) if a != b]

        def cost(x, scores=scores, edges=edges):
            return sum(s if not y else 0 for s, y in zip(scores, x, strict=True) if s > 0) + sum(-s if y else 0 for s, y in zip(scores, x, strict=True) if s < 0) + sum(c for a, b, c in edges if x[a] != x[b])

        assert cost(htmltext.min_cut(scores, edges)) == pytest.approx(min(cost(x) for x in itertools.product([True, False], repeat=n)))


def test_extract_text_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "x"), (3, "v", "", "y")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in htmltext.extract_text(pages).collect()}
    assert rows[1]["n_chars"] == len(rows[1]["text"]) > 50 and rows[2]["text"] == rows[3]["text"] == "" and rows[2]["n_chars"] == 0


def test_crc_is_unsigned_little_endian(spark):
    ids = np.array([1, 70000], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(ids),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(ids)


def test_shards_and_line_dedup_keep_columns_of_any_name(spark):
    names = ["__size", "__part", "__tie", "__before", "__row", "__all", "__lines", "__key", "__first"]
    rows = docs(spark, ODD).select("doc_id", "text", "size", *[F.lit(str(k)).alias(n) for k, n in enumerate(names)])
    for out in (balanced_shards(rows, 2, ["doc_id"], "size"), dedup_lines(rows)):
        assert out.count() == len(ODD) and {tuple(r) for r in out.select(*names).collect()} == {tuple(map(str, range(len(names))))}


def test_scratch_tables_of_other_results_stay(spark, tmp_path):
    from hexcast.llm.shared import forget, scope, written

    lazy = written(docs(spark, ODD), "lazy")
    with scope():
        kept = written(docs(spark, ODD), "kept")
        gone = written(docs(spark, ODD), "gone")
        forget(spark, but=kept)
        with pytest.raises(Exception, match="(?i)exist|not.found"):
            gone.collect()
    assert lazy.count() == kept.count() == len(ODD)
