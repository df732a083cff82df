"""Operator 6, PII: generators propose spans, boosted trees select, base patterns always stay.

High-recall generators propose overlapping spans (separated or bare digits, written-out addresses,
dotted numbers). Boosted trees score each proposal from format and context features; a threshold calibrated for
its kind decides which proposals are added. No labelled spans exist, so the trees are fitted on
TRAINING_SPANS seeded synthetic sentences in the formats that people write, half of them look-alikes
(versions, amounts, dates, part numbers).
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexcast.llm.shared import lean, small_batches, written

KINDS = ("email", "ip", "card", "phone")
TRAINING_SPANS = 4000
PRECISION = 0.98  # wanted on the calibration half of the training spans

# fixed patterns of the base spans
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# generators of further proposals: wide on purpose, and without a longest length
_AT = r"(?:@|[\[({]\s?at\s?[\])}]|\s(?:at|AT)\s)"
_DOT = r"(?:\.|[\[({]\s?dot\s?[\])}]|\s(?:dot|DOT)\s)"
_WORDY = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?{_AT}\s?[A-Za-z0-9-]++(?:\s?{_DOT}\s?[A-Za-z0-9-]{{2,}}+)+")
_DIGITS = re.compile(r"(?<![A-Za-z0-9])[(+]?[0-9](?:[\x20(). /_-]{0,2}[0-9])*+(?![A-Za-z0-9])")
# fixed values: digits of a phone number and of a card number
PHONE_DIGITS, CARD_DIGITS = range(7, 16), range(13, 20)
_DOTTED = re.compile(r"[0-9]{1,3}(?:\s?[.,·]\s?[0-9]{1,3}|\[\.\][0-9]{1,3}){3}")
_PHONE_WORDS = ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "telefon", "tél", "móvil")
_CARD_WORDS = ("card", "visa", "credit", "debit", "master", "amex", "karte", "carte", "tarjeta")
_MAIL_WORDS = ("mail", "contact", "write", "reach", "correo", "courriel")
_IP_WORDS = ("ip", "host", "server", "address", "login", "client", "from")
_DULL_WORDS = ("version", "v", "part", "order", "isbn", "serial", "total", "price", "date", "page", "no", "id", "release")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans (start, end, kind), in order of start and then kind."""
    out, last = [], 0
    at = text.find("@")
    while at != -1:  # a local part is the whole run of its signs before the at sign
        start = at
        while start > last and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            last = found.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Overlapping candidate spans beyond the base ones, by the wide generators."""
    out = []
    if "@" in text or " at " in text or " AT " in text or "at]" in text or "at)" in text or "at}" in text:
        out += [(m.start(), m.end(), "email") for m in _WORDY.finditer(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), "ip") for m in _DOTTED.finditer(text)]
        for m in _DIGITS.finditer(text):
            n = sum(map(len, re.findall("[0-9]+", m[0])))
            if n in PHONE_DIGITS:
                out.append((m.start(), m.end(), "phone"))
            if n in CARD_DIGITS:
                out.append((m.start(), m.end(), "card"))
            if n > PHONE_DIGITS[-1]:
                out += _parts(m.start(), m[0])
    return out


def _parts(start: int, run: str) -> list[tuple[int, int, str]]:
    """Proposals inside a long run of digit groups: neighbouring groups of together as many digits as a number has."""
    groups = [(g.start(), g.end()) for g in re.finditer(r"[(+]?[0-9]+", run)]
    out = []
    for k, (low, _) in enumerate(groups):
        digits = 0
        for a, high in groups[k:]:
            digits += high - a - (run[a] in "(+")
            if digits > CARD_DIGITS[-1]:
                break
            if high - low < len(run):  # the whole run has been proposed
                if digits in PHONE_DIGITS:
                    out.append((start + low, start + high, "phone"))
                if digits in CARD_DIGITS:
                    out.append((start + low, start + high, "card"))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context features of a candidate span."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    before = text[max(0, start - 40) : start].lower()
    words = re.findall(r"[^\W\d_]+", before)[-4:]
    near = lambda names: float(any(w.startswith(n) if len(n) > 2 else w == n for w in words for n in names))
    after = text[end : end + 1]
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    parts = [int(g) for g in re.findall("[0-9]+", span)[:8] if len(g) < 10]
    return [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(luhn(digits) if 13 <= len(digits) <= 19 else 0), float(len(parts) == 4 and max(parts) <= 255), float(span[:1] == "+"), float("(" in span),
        float(span.count("-")), float(span.count(".")), float(span.count(" ")), float("@" in span), float(bool(re.search(r"\b(?:at|AT)\b", span))),
        float(bool(re.search(r"\b(?:dot|DOT)\b", span))), near(_PHONE_WORDS), near(_CARD_WORDS), near(_MAIL_WORDS), near(_IP_WORDS), near(_DULL_WORDS),
        float(start > 0 and (text[start - 1].isalnum() or text[start - 1] in "$#/.,-_")), float(after.isalnum() or after in ("/", "_", "%")),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}.*", span))), float("," in span), float("/" in span),
    ]


def synthetic_spans(n: int, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """n labelled candidate spans: (text, start, end, kind, label), in seeded variations."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    filler = lambda k: " ".join("".join(pick("aeiounrstldm") for _ in range(int(rng.integers(2, 9)))) for _ in range(k))

    def card(k: int) -> str:
        body = str(rng.integers(3, 7)) + num(k - 2)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def split(digits: str, sizes, sign: str) -> str:
        cuts = np.cumsum(sizes)
        return sign.join(digits[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))

    def one(good: bool) -> tuple[str, str, str]:
        kind = pick(KINDS)
        if kind == "phone":
            if good:
                return pick(["phone", "call me on", "tel", "mobile", filler(2)]), pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"0{num(3)} {num(7)}", f"{num(3)}.{num(3)}.{num(4)}"]), kind
            return pick(["order", "total", "part no", "id", filler(2), "serial"]), pick([num(9), num(12), f"20{num(2)}-0{rng.integers(1, 9)}-1{num(1)} 1{num(1)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)} {num(4)}"]), kind
        if kind == "card":
            if good:
                k = pick([14, 15, 16, 16, 16, 19])
                c = card(k)
                return pick(["card", "visa", "credit card", filler(2)]), pick([c, split(c, [4] * (k // 4) + [k % 4] * bool(k % 4), "-"), split(c, [4] * (k // 4) + [k % 4] * bool(k % 4), " "), split(c, [4] * (k // 4) + [k % 4] * bool(k % 4), ".")]), kind
            bad = card(16)
            return pick(["isbn", "serial", "order", filler(2)]), bad[:-1] + str((int(bad[-1]) + 1 + int(rng.integers(8))) % 10), kind
        if kind == "ip":
            parts = [str(p) for p in rng.integers(1, 255, 4)]
            if good:
                return pick(["host", "ip", "login from", filler(2)]), pick([".".join(parts), "[.]".join(parts)]), kind
            return pick(["version", "release", "v", filler(2)]), pick([", ".join(parts), ",".join(parts), f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{num(3)}.{rng.integers(300, 999)}"]), kind
        user, host = filler(1) + pick([".", "_", ""]) + num(2), filler(1)
        if good:
            return pick(["mail", "contact", "write to", filler(2)]), pick([f"{user}@{host}.com", f"{user} at {host} dot com", f"{user} [at] {host} [dot] org", f"{user}(at){host}.net"]), kind
        return filler(2), pick([f"{filler(1)} at {filler(1)}.{filler(1)}", f"{filler(1)} at {filler(1)}. {filler(1)}"]), kind

    out = []
    for k in range(n):
        lead, span, kind = one(k % 2 == 0)
        head = f"{filler(3)} {lead} "
        out.append((f"{head}{span} {filler(3)}", len(head), len(head) + len(span), kind, 1 - k % 2))
    return out


def fit_selector(spark: SparkSession):
    """(model, thresholds): boosted trees on half of the synthetic spans, a threshold for each kind on the other.

    A kind's threshold is the least probability, 0.5 or more, down to which its held spans have the wanted precision.
    """
    rows = [([float(x) for x in features(t, a, b, k)], float(y), i % 4 < 2, k) for i, (t, a, b, k, y) in enumerate(synthetic_spans(TRAINING_SPANS))]
    data = spark.createDataFrame(rows, "features array<double>, label double, fit boolean, kind string")
    data = data.repartition(1).withColumn("features", array_to_vector("features"))
    model = GBTClassifier(maxIter=20, maxDepth=4, seed=3).fit(data.where("fit"))
    held = model.transform(data.where("not fit")).select(vector_to_array("probability")[1].alias("p"), "label", "kind").toPandas()
    thresholds = {}
    for kind, own in held.sort_values(["p", "label"], ascending=False).groupby("kind"):  # at most TRAINING_SPANS rows
        precision = own["label"].cumsum() / np.arange(1, len(own) + 1)
        good = own["p"][precision >= PRECISION]
        thresholds[kind] = max(0.5, float(good.min())) if len(good) else 1.1
    return model, thresholds


class Taken:
    """Disjoint spans in order; finding room for one costs the logarithm of their number."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def take(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (start, end, kind) in code points, end exclusive.

    base holds the fixed patterns' spans; spans adds the selected proposals that overlap none of them,
    likelier ones first. Null and empty texts have no spans; repeated rows each get a row. A document's
    own candidates are gathered per document only. Texts of any length are scanned whole. Among proposals that
    overlap, equally likely ones go by start, then end, then kind.
    """
    span = "struct<start: int, end: int, kind: string>"

    def scan(batches):
        task = TaskContext.get().partitionId() << 33
        done = 0
        for batch in batches:
            base, extra = [], []
            for t in batch["text"]:
                b = base_spans(t)
                taken = Taken((s[0], s[1]) for s in b)
                more = []
                for s in proposals(t):
                    if taken.free(s[0], s[1]):
                        more.append({"start": s[0], "end": s[1], "kind": s[2], "features": features(t, *s)})
                base.append([{"start": s[0], "end": s[1], "kind": s[2]} for s in b])
                extra.append(more)
            n = len(batch)
            yield pd.DataFrame({"doc_id": batch["key"], "uid": task + done + np.arange(n), "base": base, "extra": extra})
            done += n

    small_batches(docs.sparkSession)
    # the key goes through Python as text, which keeps 64-bit numbers exact beside nulls
    rows = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = "array<struct<start: int, end: int, kind: string, features: array<double>>>"
    scanned = written(rows.mapInPandas(lean(scan), f"doc_id string, uid long, base array<{span}>, extra {fields}"), "pii")
    model, thresholds = fit_selector(docs.sparkSession)
    found = scanned.select("uid", F.explode("extra").alias("c")).select("uid", "c.*")
    scored = model.transform(found.withColumn("features", array_to_vector("features")))
    needed = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    scored = scored.withColumn("p", vector_to_array("probability")[1]).where(F.col("p") >= needed[F.col("kind")])
    likely = scored.groupBy("uid").agg(F.collect_list(F.struct((-F.col("p")).alias("q"), "start", "end", "kind")).alias("likely"))

    @F.pandas_udf(f"array<{span}>")
    def choose(base: pd.Series, more: pd.Series) -> pd.Series:
        def one(b, m) -> list[dict]:
            if m is None:
                return [dict(r) for r in b]
            kept = [(r["start"], r["end"], r["kind"]) for r in b]
            taken = Taken((a, e) for a, e, _ in kept)
            for r in sorted(m, key=lambda r: (r["q"], r["start"], r["end"], r["kind"])):
                if taken.free(r["start"], r["end"]):
                    taken.take(r["start"], r["end"])
                    kept.append((r["start"], r["end"], r["kind"]))
            kept.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            return [{"start": a, "end": e, "kind": k} for a, e, k in kept]

        return pd.Series([one(b, m) for b, m in zip(base, more, strict=True)])

    out = scanned.select("doc_id", "uid", "base").join(likely, "uid", "left")
    out = out.withColumn("chosen", choose("base", "likely"))
    return out.select(F.col("doc_id").cast("long"), "base", F.col("chosen").alias("spans"))


def joined(spans: str):
    """kind:start:end of an array of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
