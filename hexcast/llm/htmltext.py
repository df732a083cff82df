"""Operator 9, HTML extraction: minimum-cut labelling of text blocks.

A page becomes text blocks that point to their element. Runs of blocks in the same element and of the same
kind are one node. A linear classifier's costs are the capacities between a node and the two terminals
(content, boilerplate); neighbours on the page, nodes of one element and nodes of an element and its parent
are joined by smoothness edges. The maximum flow's cut labels the nodes: it pays least for disagreeing with
the classifier and for separating close nodes.

The classifier reads element names, roles and whole class or id words: the words of `post-content` are a
name with its last part as the head, those of `has-sidebar`, `modal-open` or `category-legal` describe a
state or a topic and say nothing. Time and memory are linear in the page, whatever its depth.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexcast.llm.shared import small_batches

# fixed values: element names of HTML
_RAW = "script style title textarea xmp iframe noembed noframes".split()
_SKIPPED = frozenset("template noscript svg math object canvas video audio select datalist".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote caption figcaption".split())
_PROSE = frozenset("p h1 h2 h3 pre blockquote figcaption".split())
_ITEMS = frozenset("li dt dd".split())
_PROSE_PARTS = frozenset("ul ol dl table tbody figure blockquote pre".split())
_PAGE = frozenset(("", "html", "body"))
#: optional end tags: what an element's start ends, looked for through elements of the second set only
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_THROUGH = {"tr": {"td", "th"}}
_NO_CONTENT = frozenset("nav footer aside form button dialog menu fieldset legend search".split())
_CONTENT = frozenset(("article", "main"))
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_UNSEEN = frozenset("hidden d-none display-none is-hidden visually-hidden sr-only screen-reader-text".split())

# names that speak for boilerplate: alone or as the last part of a name ...
_BAD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners nav navbar navigation menu menus submenu "
    "breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar comment comments reply replies disqus respond discussion cookie cookies consent gdpr notice notices alert alerts "
    "popup popups modal overlay newsletter newsletters subscribe subscription signup login signin share sharing social related recommended recommendations pagination pager copyright legal disclaimer "
    "toolbar skip toc tags taglist feedback guestbook talkback".split()
)
#: readers: with one of the second words as the last part, what they wrote
_READERS = frozenset("user users reader readers guest guests visitor visitors member members".split())
_WRITTEN = frozenset("post posts entry entries text content message messages body review reviews opinion opinions".split())
#: ... and, as the first part, together with one of these last parts
_PARTS = frozenset(
    "list box block area section wrap wrapper container buttons button bar links link panel items item form thread text body content inner slot unit holder zone message messages policy settings posts "
    "stories articles title heading header label meta author count icons icon group row column region".split()
)
_GOOD = frozenset("article content entry post story main text body prose".split())
#: first and last parts of names that describe a state or a topic
_STATES = frozenset("has with without no not is are can show hide hides toggle js category tag topic type format status overflow align after before under above".split())
_STATED = frozenset("open opened enabled disabled active inactive visible closed on off loaded ready count".split())
#: the words that count on article and main elements, where other bad words are topics
_NEVER = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(_RAW) + r")(?=[\s/>])(?:(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*>).*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# the classifier's weights and the smoothness, in the same unit
SURE, NAMED, NATURE, LENGTH, LINKS = 7.0, 6.0, 1.0, 1.5, 4.0
NEXT_TO, SAME_ELEMENT, PARENT = 0.8, 0.8, 0.5


class Element:
    """An open element: name, parent, the score of its path and the element that its blocks are grouped by."""

    __slots__ = ("content", "group", "name", "parent", "score", "skipped")

    def __init__(self, name: str, attributes: str, parent: Element | None, wide: bool = False):
        self.name, self.parent = name, parent
        self.content = name in _CONTENT or bool(parent and parent.content)
        self.skipped = name in _SKIPPED or bool(parent and parent.skipped)
        above = parent.score if parent else 0.0
        own = 0.0 if wide else element_score(name, attributes, bool(parent and parent.content))
        # boilerplate inside content is boilerplate; content inside boilerplate only makes it less sure
        self.score = max(-2 * SURE, min(above, 0.0) + own) if own < 0 else min(NAMED, above + own)
        self.group = parent.group if parent and name in _LEAVES and not own else self


class Block:
    """A text block: raw text parts, characters inside links, and its element."""

    __slots__ = ("element", "linked", "parts")

    def __init__(self, element: Element):
        self.parts, self.linked, self.element = [], 0, element

    def text(self) -> str:
        raw = "".join(self.parts)
        return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def name_score(word: str) -> float:
    """How far one word of a class or id speaks for content (> 0) or boilerplate (< 0)."""
    if word.lower() in _UNSEEN:
        return -SURE
    parts = [p for p in re.split(r"[-_]+", _HUMPS.sub("-", word.split("--")[0]).lower()) if p]
    if not parts or len(parts) > 1 and (parts[0] in _STATES or parts[-1] in _STATED):
        return 0.0
    first, last = parts[0], parts[-1]
    if last in _BAD or last in ("side", "bar") and first in ("side", "top", "nav", "tool"):
        return -SURE
    if len(parts) > 1 and (last in _PARTS and first in _BAD or last in _WRITTEN and first in _READERS):
        return -SURE
    if last == "header":
        return -SURE if first in ("header", "site", "global", "top", "main") else 0.0
    return NAMED / 2 if last in _GOOD else 0.0


def element_score(name: str, attributes: str, in_content: bool) -> float:
    """The score of an element by its name, role, visibility and the words of its class and id."""
    if name in _NO_CONTENT or name == "header" and not in_content:
        return -SURE
    score = NAMED if name in _CONTENT else 0.0
    if not attributes or name in ("html", "body"):
        return score
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for word in value.split():
                sign = name_score(word)
                if sign < 0 and not (score > 0 and name in _CONTENT and word.lower() not in _NEVER and word.lower() not in _UNSEEN):
                    return -SURE
                score = max(score, sign)
        elif key == "role" and value.lower() in _BAD_ROLES:
            return -SURE
        elif key == "role" and value.lower() in _CONTENT:
            score = NAMED
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return -SURE
    return score


_FORM_END = re.compile(r"</form\b", re.I)


def _wraps(page: str, at: int) -> bool:
    """Whether a form that begins here holds most of the page; such a form is a wrapper and not something to fill in."""
    end = _FORM_END.search(page, at)
    return ((end.start() if end else len(page)) - at) > 0.5 * len(page)


def blocks_of(page: str) -> list[tuple[Block, str]]:
    """The non-empty text blocks of a page, in order, with their text."""
    out: list[tuple[Block, str]] = []
    top = Element("", "", None)
    opened: dict[str, int] = {}
    linked, at = False, 0
    block = Block(top)

    def end() -> None:
        nonlocal block
        if block.parts and (text := block.text()):
            out.append((block, text))
        block = Block(top)

    def add(raw: str) -> None:
        if not top.skipped:
            block.parts.append(raw)
            if linked:
                block.linked += len(raw)

    def pop() -> None:
        nonlocal top
        opened[top.name] -= 1
        top = top.parent

    def close(name: str) -> None:
        if opened.get(name):
            while top.name != name:
                pop()
            pop()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            if m[1]:
                add(" ")
            continue
        name = name.lower()
        structural = name in _BLOCKS or name in _SKIPPED
        if m[2]:
            if name == "a":
                linked = False
            elif structural:
                close(name)
                end()
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            linked = True
        if not structural:
            continue
        if name in _BLOCKS:
            linked = False
            if top.name in ("svg", "math"):  # blocks end drawings
                pop()
        through = _THROUGH.get(name, ())
        if wanted := _CLOSED_BY.get(name):
            e = top
            while e.name in through and e.name not in wanted:
                e = e.parent
            if e.name == "p" and e.parent:
                e = e.parent
            if e.name in wanted:
                while top is not e:
                    pop()
                pop()
        if top.name == "p" and name in _BLOCKS:  # a paragraph ends where a block begins
            pop()
        if name not in _VOID and not (name in ("html", "body", "head") and opened.get(name)) and not (name in _SKIPPED and m[4].endswith("/")):
            top = Element(name, m[4], top, name == "form" and _wraps(page, m.start()))
            opened[name] = opened.get(name, 0) + 1
        end()
    if at < len(page):
        add(page[at:])
    end()
    return out


def _nodes(blocks: list[tuple[Block, str]]) -> list[dict]:
    """Runs of blocks in one element and of one nature, with the classifier's score."""
    out: list[dict] = []
    for k, (b, text) in enumerate(blocks):
        group, linked = b.element.group, b.linked > 0.5 * len(text)
        if not out or out[-1]["group"] is not group or out[-1]["links"] != linked:
            out.append({"group": group, "links": linked, "first": k, "chars": 0, "linked": 0, "prose": False, "items": False})
        node = out[-1]
        node["chars"] += len(text)
        node["linked"] += b.linked
        node["prose"] |= b.element.name in _PROSE
        node["items"] = b.element.name in _ITEMS
        node["last"] = k
    small = max((n["chars"] for n in out), default=0) < 200  # a page without any long run: shortness tells nothing
    for node in out:
        score = node["group"].score + (NATURE if node["prose"] else 0.0 if small and node["items"] else -NATURE)
        score += LENGTH if node["chars"] >= 200 else -LENGTH * 0.5 if node["chars"] < 40 and not small else 0.0
        node["score"] = score - LINKS * min(1.0, node["linked"] / max(1, node["chars"]))
    return out


def _above(e: Element) -> Element | None:
    """The element that an element belongs to; what stands in the body itself belongs to it only if it is a part of prose."""
    up = e.parent.group if e.parent else None
    return up if up and (up.name not in _PAGE or e.name in _PROSE_PARTS) else None


def _close(a: Element, b: Element) -> bool:
    """Whether two elements are the same, one the other's parent, or siblings below a marked element."""
    return a is b or _above(a) is b or _above(b) is a or _above(a) is _above(b) and bool(_above(a) and _above(a).score)


def _edges(nodes: list[dict]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, nodes of one element, nodes of an element and its parent."""
    out = []
    last: dict[int, int] = {}  # element -> the last node in it
    for k, node in enumerate(nodes):
        group = node["group"]
        if k:
            out.append((k - 1, k, NEXT_TO if _close(nodes[k - 1]["group"], group) else NEXT_TO / 4))
        if id(group) in last:
            out.append((last[id(group)], k, SAME_ELEMENT))
        above = _above(group)
        if above and id(above) in last:
            out.append((last[id(above)], k, PARENT))
        last[id(group)] = k
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of the minimum cut, by blocking flows (Dinitz, 1970).

    A positive score is the capacity from the content terminal to the node, a negative one that from the
    node to the boilerplate terminal; edges have their capacity both ways.
    """
    n = len(scores)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, s in enumerate(scores):
        if s > 0:
            join(source, k, s, 0.0)
        elif s < 0:
            join(k, sink, -s, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[full] ^ 1]
                del path[full:]
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def main_text(page: str) -> str:
    """Content blocks of a page, joined by two line feeds; empty if there is none."""
    blocks = blocks_of(page)
    nodes = _nodes(blocks)
    content = min_cut([n["score"] for n in nodes], _edges(nodes))
    kept = [blocks[k][1] for n, yes in zip(nodes, content, strict=True) if yes for k in range(n["first"], n["last"] + 1)]
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """Replace the column page by text (string) and n_chars (long, code points), for every row.

    Null and empty pages have an empty text; other columns stay, and existing columns text and n_chars
    are replaced; repeated rows each get a row with the same text, an empty table gives none. Each page is
    handled alone, as a whole, in time and memory linear in its length. A block whose two labels cost the
    same is boilerplate.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(pages_: pd.Series) -> pd.Series:
        return pages_.map(main_text)

    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    out = pages.select(*kept, extract(F.coalesce(F.col(page), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
