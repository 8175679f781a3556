"""Call transcripts: addresses, sections, people, and the split into remarks and questions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The address form, words that begin no name, headings and markers in their order.
ADDRESS = r"/earnings/call-transcripts/(\d{4})/(\d{2})/(\d{2})/(.+?)-([a-z]+(?:-[a-z])?)-(?:q(\d)-)?(\d{4})-earnings"
NO_NAMES = frozenset(
    "A About After All Also An And Are As At Be But By Can Do Did For From Get Had Has Have He Her Here His How I If In Into Is It Its Just Let Like May More My No Not Now Of On One Or Our Out Over "
    "So Some Such Than That The Their Then There These They This To Up Very Was We Were What When Which While Who Why Will With Would You Your".split()
)
REMARKS, QUESTIONS, PEOPLE = ("PREPARED REMARKS",), ("QUESTIONS & ANSWERS", "QUESTIONS AND ANSWERS", "Q&A"), ("CALL PARTICIPANTS",)
MARKERS = ("questions & answers", "questions and answers", "we will now begin the question", "question-and-answer session", "q&a session", "open the line for questions")


def ticker_of(slug: Column) -> Column:
    """brk-a is BRK.A; others in capitals."""
    return F.when(slug.rlike("^[a-z]+-[a-z]$"), F.replace(F.upper(slug), F.lit("-"), F.lit("."))).otherwise(F.upper(slug))


def from_address(url: Column) -> Column:
    """(ticker, quarter, year, pub_date), null where the address names no quarter."""
    part = lambda i: F.regexp_extract(F.lower(url), ADDRESS, i)
    whole = F.struct(ticker_of(part(5)).alias("ticker"), F.concat(F.lit("Q"), part(6)).alias("quarter"), F.try_to_number(part(7), F.lit("9999")).cast("int").alias("year"), F.concat_ws("-", part(1), part(2), part(3)).alias("pub_date"))
    return F.when(part(6) != "", whole)


def speakers_in_text(text: Column) -> Column:
    """Names before a colon at the beginning of a line: two words or more, not all capitals; sorted, each once."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_extract(F.trim(x), r"^([A-Z][A-Za-z\s.\-']+?)(?:\s*,\s*[A-Za-z\s]+)?:", 1)))
    good = lambda n: n.rlike(r"\S\s+\S") & n.rlike("[a-z]") & ~F.array_contains(F.array(*[F.lit(w) for w in sorted(NO_NAMES)]), F.regexp_extract(n, r"^\S+", 0))
    return F.array_sort(F.array_distinct(F.filter(lines, good)))


def split_at_marker(text: Column) -> Column:
    """(prepared, questions) at the first marker in marker order; without one all is prepared."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.instr(low, m), F.lit(0)) for m in MARKERS])
    whole = F.struct(text.alias("prepared"), F.lit("").alias("questions"))
    cut = F.struct(F.trim(F.substring(text, F.lit(1), at - 1)).alias("prepared"), F.trim(F.substring(text, at, F.length(text))).alias("questions"))
    return F.when(at.isNull(), whole).otherwise(cut)


def news_article(html: Column) -> Column:
    """(headline, date, ticker) of the first NewsArticle among a page's JSON-LD blocks; the ticker is the last word of its symbol."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    schema = "`@type` string, headline string, datePublished string, about array<struct<tickerSymbol:string>>"
    first = F.try_element_at(F.filter(F.transform(blocks, lambda b: F.from_json(b, schema)), lambda x: x["@type"] == "NewsArticle"), F.lit(1))
    symbol = F.try_element_at(F.filter(F.transform(first["about"], lambda a: a["tickerSymbol"]), lambda s: F.coalesce(s, F.lit("")) != ""), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["headline"].alias("headline"), first["datePublished"].alias("date"), F.element_at(F.split(symbol, r"\s+"), -1).alias("ticker")))


class _Sections(HTMLParser):
    """Blocks by their last h2: (kind, text, first bold text).  A list is a block, and each of its items one beside it."""

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, list[tuple[str, str, str]]] = {}
        self.now, self.block, self.text, self.bold, self.in_bold = "", "", "", "", 0
        self.lists, self.whole = 0, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("ul", "ol"):
            self.flush()
            self.lists += 1
        elif tag in ("p", "li", "h2"):
            self.flush()
            self.block = tag
        elif tag == "strong":
            self.in_bold += 1

    def handle_endtag(self, tag):
        if tag == "strong":
            self.in_bold = max(0, self.in_bold - 1)
            self.bold += "\0"
        elif tag in ("ul", "ol") and self.lists:
            self.flush()
            self.lists -= 1
            if not self.lists:
                if text := self.whole.strip():
                    self.found.setdefault(self.now, []).append(("list", text, ""))
                self.whole = ""
        elif tag == self.block:
            self.flush()

    def handle_data(self, data):
        if self.lists:
            self.whole += data
        if self.block:
            self.text += data
            if self.in_bold and "\0" not in self.bold:
                self.bold += data

    def flush(self):
        text = self.text.strip()
        if self.block == "h2":
            self.now = re.sub(r":+$", "", text).strip().upper()
            self.found.setdefault(self.now, [])
        elif text and not (self.lists and self.block == "p"):
            self.found.setdefault(self.now, []).append((self.block, text, self.bold.rstrip("\0").strip()))
        self.block, self.text, self.bold = "", "", ""


def sections(page: str | None) -> dict[str, list[tuple[str, str, str]]]:
    parser = _Sections()
    parser.feed(page or "")
    parser.flush()
    return parser.found


def parse(page: str | None) -> dict:
    """participants, speakers, prepared and questions of one transcript page."""
    found = sections(page)
    of = lambda names: next((found[n] for n in names if n in found), [])
    people = [t for kind, t, bold in of(PEOPLE) if kind == "li" or (bold and len(t) < 200)]
    speakers = {
        bold for names in (REMARKS, QUESTIONS) for kind, t, bold in of(names)
        if kind == "p" and len(bold) > 2 and len(bold) >= 0.3 * len(t) and ":" not in bold and bold.split()[0] not in NO_NAMES
    }
    join = lambda blocks: "\n\n".join(t for kind, t, _ in blocks if kind != "li")
    prepared, questions = join(of(REMARKS)), join(of(QUESTIONS))
    if not (prepared and questions):
        whole = join([b for blocks in found.values() for b in blocks])
        at = next((i for i in (whole.lower().find(m) for m in MARKERS) if i >= 0), len(whole))
        prepared, questions = whole[:at].strip(), whole[at:].strip()
    return {"participants": people, "speakers": sorted(speakers), "prepared": prepared, "questions": questions}


_PAGE = StructType([StructField("participants", ArrayType(StringType())), StructField("speakers", ArrayType(StringType())), StructField("prepared", StringType()), StructField("questions", StringType())])


@F.pandas_udf(_PAGE)
def parsed_page(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(p) for p in pages], columns=["participants", "speakers", "prepared", "questions"])
