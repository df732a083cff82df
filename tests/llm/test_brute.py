"""Registered queries against plain single-machine versions on the smallest tables."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest

from hexcast.llm.queries import QUERIES


@pytest.fixture(scope="module")
def table(data):
    return pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()


def run_end(lines, i):
    """The last line of the shortest run from line i, or None."""
    if len(lines[i]) >= 160 or len(lines[i].split()) > 50:
        return i
    size = len(lines[i])
    for j in range(i + 1, len(lines)):
        size += 1 + len(lines[j])
        if size >= 80:
            return j
    return None


def runs(text):
    lines = text.split("\n")
    out = {(i, e) for i in range(len(lines)) if (e := run_end(lines, i)) is not None}
    back = [x[::-1] for x in lines[::-1]]
    last = len(lines) - 1
    out |= {(last - e, last - i) for i in range(len(lines)) if (e := run_end(back, i)) is not None and e > i}
    return lines, out


def plain_line_dedup(rows):
    first, out = {}, {}
    for r in rows:  # rows come in ascending doc_id
        if r["text"] is None:
            out[r["doc_id"]] = (None, 0)
            continue
        lines, own = runs(r["text"])
        gone = set()
        for i, e in sorted(own):
            doc, at = first.setdefault("\n".join(lines[i : e + 1]), (r["doc_id"], i))
            if doc != r["doc_id"] or i > at + (e - i):
                gone.update(range(i, e + 1))
        out[r["doc_id"]] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else r["text"], len(gone))
    return out


def test_line_dedup(spark, data, table):
    ours = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in QUERIES["op8_line_dedup"](spark, data).collect()}
    assert ours == plain_line_dedup(table)
    assert sum(n for _, n in ours.values()) > 20


# the base patterns of personal data as the contract words them, left to right with possessive-free regexes
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    each = [int(d) for d in digits[::-1]]
    return sum(each[::2]) % 10 == -sum(d * 2 - 9 * (d > 4) for d in each[1::2]) % 10


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base(spark, data, table):
    ours = {r["doc_id"]: r for r in QUERIES["op6_pii"](spark, data).collect()}
    assert len(ours) == len(table)
    for r in table:
        base = plain_base(r["text"] or "")
        own = ours[r["doc_id"]]
        joined = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert own["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [own[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[2] == k for x in base) for k in ("email", "ip", "card", "phone")]
        spans = own["spans"].split(",") if own["spans"] else []
        assert set(joined) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), ["email", "ip", "card", "phone"].index(s.split(":")[0])))


def test_html_query_is_the_operator(spark, data):
    from hexcast.llm.htmltext import main_text

    pages = {r["page_id"]: r for r in pq.read_table(f"{data}/pages.parquet").to_pylist()}
    ours = QUERIES["op9_html_extraction"](spark, data).collect()
    assert {r["page_id"] for r in ours} == set(pages) and len(ours) == len(pages)
    for r in ours:
        assert r["text"] == main_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
