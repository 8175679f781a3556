"""Main text of HTML pages by a maximum-scoring subsequence.

A page is cut into tokens: words and tags.  A token's kind is its tag, or for a word the
container around it (article, navigation, advert and so on, by element and by class or
id); its weight is the log-odds of that kind inside and outside the main text of the
labelled pages.  One linear scan finds the contiguous run of tokens with the largest sum.
The blocks of that run, without those that lie in containers of other kinds (adverts,
notices, forms, comments), are the text.

Nulls and edge cases: a null or empty page, or one without positive run, has an empty
text; unclosed, misnested and truncated markup is read as far as it goes, an unfinished
tag at the end is dropped; scripts, styles and comments are never text, whatever they
hold; a br is white space inside its block; equal pages give equal texts; a null page_id
is kept; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled_pages import PAGES

_TOKEN = re.compile(
    r"""<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<tag>/?[a-zA-Z][a-zA-Z0-9:-]*|[!?])(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)(?P<end>>|\Z)|<(?P<torn>/?[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that end a block.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end, which hold nothing.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out, with what ends them when it starts and what keeps that inside.
_ENDED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",))), "th": (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",))),
    "tr": (frozenset(("tr", "tbody", "tfoot")), frozenset(("table",))), "option": (frozenset(("option", "optgroup")), frozenset(("select", "datalist"))), "p": (_BLOCKS, frozenset()),
}
#: Elements whose names say less: within a line only what is no text of the page's author, for headings the same, for rows and cells no header.
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("tr td th thead tbody tfoot caption col colgroup".split())
_BY_ELEMENT = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "select": "form", "datalist": "form", "option": "form", "label": "form", "dialog": "notice", "article": "article", "main": "article"}
#: Kinds by words in class, id and role; the first that is there counts.
_BY_NAME = tuple((kind, re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)) for kind, words in (
    ("comments", "comments?|commentlist|replies|reply|respond|disqus|discussion"),
    ("advert", "ads?|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion"),
    ("notice", "notice|notices|cookie|cookies|consent|gdpr|popup|modal|alert|newsletter|subscribe|subscription|paywall"),
    ("menu", "menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toc|tabs"),
    ("sidebar", "sidebar|aside|widget|widgets|related|recommended|trending|popular|share|sharing|social|tags|rail|complementary"),
    ("footer", "footer|foot|copyright|colophon|contentinfo"),
    ("header", "header|masthead|topbar|banner"),
    ("form", "form|search|login|signup|register"),
    ("article", "article|content|main|post|entry|story|body-text|post-body|entry-content"),
))
#: Parts of a name before which or after which it says what an element has or lacks, not what it is.
_ABOUT = frozenset("has with without no not is layout".split())
#: Names by which an article is none of the page's own: another reader's, an advert, or the start of another page's.
_OTHER_ARTICLES = frozenset("comment comments reply advert ad sponsored promo teaser card preview related recommended".split())
#: What passing from one article into the next one costs in the scan: a teaser is not worth it, the next part of a long text is.
BETWEEN_ARTICLES = -25.0
#: Elements that hold the whole page or its main text, whatever their names say besides.
_WHOLE = frozenset(("html", "body", "main", "article"))
_APART = frozenset(("comments", "advert", "notice", "menu", "sidebar", "footer", "header", "form"))


def _kind(tag: str, rest: str) -> str | None:
    if rest and (m := _NAMED.findall(rest)):
        names = " ".join(a or b or c for a, b, c in m).split()
        told = [n for n in names if not _ABOUT.intersection(re.split("[-_]", n.lower())[:-1])]
        if tag in _WHOLE:
            # One comment or one advert may be an article of its own; other names of an article are its topics.
            told = [n for n in told if n.lower() in _OTHER_ARTICLES] if tag == "article" else []
        for kind, pattern in _BY_NAME:
            if any(pattern.search(n) for n in told):
                if tag in _INLINE and kind not in ("comments", "advert", "notice") or tag in _CELLS and kind == "header":
                    continue
                return kind
        if told and tag == "article":
            return "sidebar"
    return _BY_ELEMENT.get(tag)


class _Open:
    """The open elements, each with the kind of text in it and whether a container of another kind is around."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool]] = []
        self.count: Counter[str] = Counter()

    def state(self) -> tuple[str, bool]:
        return self.stack[-1][1:] if self.stack else ("page", False)

    def _pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        return name

    def end(self, name: str) -> None:
        if self.count[name]:
            while self._pop() != name:
                pass

    def start(self, name: str, rest: str) -> None:
        while self.stack and (top := self.stack[-1][0]) in _ENDED_BY and name in _ENDED_BY[top][0]:
            self._pop()
        if name in _VOID or rest.endswith("/"):
            return
        own, (kind, apart) = _kind(name, rest), self.state()
        if own == "header" and kind == "article":
            own = None  # a heading's header inside an article is part of the article
        if name == "main":
            kind, apart = own or "page", own in _APART  # what is around the main element says nothing of what is in it
        elif own in _APART:
            kind, apart = own, True
        elif own and not apart:
            kind = own
        self.stack.append((name, kind, apart))
        self.count[name] += 1


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(what, kind, text, apart): what is tag, text, break, next or mark; kind names the weight; apart says whether a container of another kind is around."""
    open_, articles = _Open(), 0
    for m in _TOKEN.finditer(page):
        kind, apart = open_.state()
        if m["text"]:
            yield "text", f"word:{kind}", m["text"], apart
        elif m["tag"] or m["torn"]:
            if m.end() == len(page) and not page.endswith(">"):
                return
            tag = (m["tag"] or m["torn"]).lower()
            if tag in "!?":
                continue
            closing, name = tag[0] == "/", tag.lstrip("/")
            if name in ("body", "html") and closing:
                continue
            if closing:
                open_.end(name)
            else:
                open_.start(name, m["rest"] or "")
            kind, apart = open_.state()
            if name == "article" and not closing and not apart and open_.count["article"] == 1:
                articles += 1
                if articles > 1:
                    yield "next", "", "", False
            if name in _BLOCKS:
                yield "break", f"tag:{name}:{kind}", "", apart
            elif name == "br":
                yield "text", "tag:br", " ", apart
            else:
                yield "tag", f"tag:{name}:{kind}", "", apart
        elif m["comment"] is not None and m["comment"] in ("main", "/main"):
            yield "mark", m["comment"], "", False


def learn(pages: tuple[str, ...] = PAGES) -> dict[str, float]:
    """Weight of each kind of token: the log-odds of standing inside the main text."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        seen = outside
        for what, kind, text, _ in tokens(page):
            if what == "mark":
                seen = inside if text == "" and kind == "main" else outside
            elif what != "next":
                seen[kind] += len(text.split()) if kind.startswith("word:") else 1
    return {k: max(-3.0, min(3.0, math.log((inside[k] + 0.5) / (outside[k] + 0.5)))) for k in inside | outside}


WEIGHTS = learn()
#: For kinds that no labelled page shows: words outside any container count for little, tags a little against.
_UNSEEN = {"word": 0.2, "tag": -0.2}


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The text of the best run of blocks."""
    blocks: list[tuple[float, str]] = []
    score, parts = 0.0, []
    for what, kind, text, other in tokens(page or ""):
        if what == "mark":
            continue
        if what == "next":
            score += BETWEEN_ARTICLES
            continue
        weight = weights.get(kind)
        if weight is None:
            weight = (-1.0 if other else _UNSEEN["word"]) if kind.startswith("word:") else (-0.5 if other else _UNSEEN["tag"])
        if what == "break":
            blocks.append((score, "".join(parts)))
            score, parts = weight, []
        elif what == "text":
            parts.append(" " if other else text)
            score += weight * len(text.split())
        else:
            score += weight
    blocks.append((score, "".join(parts)))
    best, first, last = 0.0, 0, 0
    running, start = 0.0, 0
    for i, (value, _) in enumerate(blocks):
        if running <= 0:
            running, start = 0.0, i
        running += value
        if running > best:
            best, first, last = running, start, i + 1
    kept = (" ".join(html.unescape(text).split()) for _, text in blocks[first:last])
    return "\n".join(t for t in kept if t)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``carry`` and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([main_text(p) for p in batch.column(0).to_pylist()], pa.string())], names=[*carry, "text"])

    rows = pages.select(F.col("html").alias("_html"), *carry)
    return rows.mapInArrow(run, rows.select(*carry).schema.add("text", "string"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
