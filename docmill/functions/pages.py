"""Main text of fetched pages in two passes: a strict one, and a lenient one where that finds too little."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Elements whose text is never read, those that the strict pass leaves out, and those that end a block.
_SILENT = frozenset("script style noscript template textarea iframe svg head select".split())
_AROUND = frozenset("nav header footer aside form button menu dialog".split())
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of a block that the strict pass takes outside of headings, and the share of its letters that links may hold.
LEAST_WORDS, LINKED = 5, 0.5
EXTRACTION = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("word_count", IntegerType()), StructField("method", StringType())])


class _Blocks(HTMLParser):
    """(text, letters in links, whether a heading, whether around the content, whether in article or main) of each block, and the title."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[tuple[str, int, bool, bool, bool]] = []
        self.open: list[str] = []
        self.text, self.linked, self.title = "", 0, ""
        self.depth = dict.fromkeys((*_SILENT, *_AROUND, "a", "article", "main", "title"), 0)
        self.heading = False

    def flush(self) -> None:
        text = " ".join(self.text.split())
        if text:
            around = any(self.depth[x] for x in _AROUND) and not (self.depth["header"] and self.depth["article"] and not any(self.depth[x] for x in _AROUND if x != "header"))
            self.blocks.append((text, self.linked, self.heading, around, bool(self.depth["article"] or self.depth["main"])))
        self.text, self.linked, self.heading = "", 0, False

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.flush()
            self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif tag == "br":
            self.text += " "
        if tag == "body":
            self.depth["head"] = 0  # a head may be left open
        if tag not in _VOID:
            self.open.append(tag)
            if tag in self.depth:
                self.depth[tag] += 1

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        if tag in self.open:
            while (top := self.open.pop()) is not None:
                if self.depth.get(top):
                    self.depth[top] -= 1
                if top == tag:
                    break

    def handle_data(self, data):
        if self.depth["title"] and not self.blocks:
            self.title += data
        elif not any(self.depth[x] for x in _SILENT):
            self.text += data
            if self.depth["a"]:
                self.linked += len("".join(data.split()))


def extract(page: str | None, least: int = 100) -> tuple[str, str, int, str]:
    """(title, text, words, method): precision, else fallback where that has fewer than ``least`` words, failed where neither finds any.

    The strict pass takes blocks of the article or main element, if there is one, that stand
    in no menu, header, footer or form, hold some words and are not mostly links; the lenient
    one every block outside of menus.
    """
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    inner = any(b[4] for b in parser.blocks)
    fine = lambda text, linked: len(text.split()) >= LEAST_WORDS and linked <= LINKED * len(text.replace(" ", ""))
    strict = "\n".join(t for t, linked, heading, around, within in parser.blocks if not around and (within or not inner) and (heading or fine(t, linked)))
    title = " ".join(parser.title.split())
    if len(strict.split()) >= least:
        return title, strict, len(strict.split()), "precision"
    lenient = "\n".join(t for t, linked, _, around, _ in parser.blocks if not (around and linked > LINKED * len(t.replace(" ", ""))))
    text = lenient if len(lenient.split()) > len(strict.split()) else strict
    return title, text, len(text.split()), "fallback" if text else "failed"


def extraction(html: Column, least: int = 100) -> Column:
    """A struct (title, text, word_count, method) for each page."""

    @F.pandas_udf(EXTRACTION)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(p, least) for p in pages], columns=EXTRACTION.fieldNames())

    return run(html)
