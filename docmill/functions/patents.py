"""Patents: identifiers, nested fields, page metadata, classification fields."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from ..operators.select import keep_first

# Forms of a patent number in running text, in the address of a patent page, and in a search result's id.
NUMBER = r"\b([A-Z]{2}\d{5,}[A-Z]\d?)\b"
IN_ADDRESS = r"patents\.google\.com/patent/([A-Z]{2}[\dA-Z]+)"
IN_RESULT = r"^patent/([A-Z]{2}[\dA-Z]+)"


def publication_number(number: Column) -> Column:
    return F.replace(number, F.lit("-"), F.lit(""))


def localized(texts: Column, language: str = "en") -> Column:
    """The text of the first element in a language."""
    return F.try_element_at(F.filter(texts, lambda x: x["language"] == language), F.lit(1))["text"]


def plucked(values: Column, field: str) -> Column:
    """One field of an array of structs, without nulls and empty ones."""
    return F.filter(F.transform(values, lambda x: x[field]), lambda x: F.coalesce(x, F.lit("")) != "")


def names_like(values: Column, patterns: list[str]) -> Column:
    """Whether any name holds any pattern, in either case; null is false."""
    return F.coalesce(F.exists(values, lambda a: F.upper(a["name"]).rlike("|".join(re.escape(p.upper()) for p in patterns))), F.lit(False))


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)))


def numbers_of_hit(url: Column, text: Column) -> Column:
    """Numbers in the addresses of a search hit, then those in its text, each once."""
    address, told = F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(address, F.lit(IN_ADDRESS), F.lit(1)), F.regexp_extract_all(told, F.lit(NUMBER), F.lit(1))))


def us_number(publication: Column) -> Column:
    """The digits of a US number, without leading zeros."""
    return F.nullif(F.regexp_extract(publication, r"^US0*(\d+)", 1), F.lit(""))


def body_text(text: Column, abstract: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), abstract)


def claims_and_description(claims: Column, description: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(claims, F.lit("")), F.nullif(description, F.lit("")))


def field_codes(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code), each once, in order: ``wanted`` (seq, name) looked up in ``fields`` (name, codes), whatever the case; a name that is not there is an error."""
    named = fields.select(F.lower("name").alias("_n"), "codes")
    found = wanted.join(named, F.lower("name") == F.col("_n"), "left")
    codes = F.when(F.col("codes").isNull(), F.raise_error(F.concat(F.lit("unknown field: "), "name"))).otherwise(F.col("codes"))
    rows = found.select("seq", F.posexplode(codes).alias("at", "code"))
    return keep_first(rows, ["code"], [F.col("seq"), F.col("at")])


def citation_edges(patents: DataFrame) -> DataFrame:
    """(src, dst, direction) from the lists of cited and citing numbers."""
    cited = patents.select(F.col("patent_id").alias("src"), F.explode("citations_backward").alias("dst"), F.lit("backward").alias("direction"))
    citing = patents.select(F.explode("citations_forward").alias("src"), F.col("patent_id").alias("dst"), F.lit("forward").alias("direction"))
    return cited.unionByName(citing).filter("src <> '' AND dst <> ''").distinct()


class _Meta(HTMLParser):
    """meta names (with scheme), itemprop texts and the title of a page, each with all its values in order."""

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, list[str]] = {}
        self.open: list[tuple[str, str]] = []

    def put(self, name: str, value: str | None) -> None:
        if value and value.strip():
            self.found.setdefault(name, []).append(" ".join(value.split()))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            name = a.get("name") or a.get("property") or a.get("itemprop")
            if name:
                self.put(f"{name}:{a['scheme']}" if a.get("scheme") else name, a.get("content"))
        elif a.get("itemprop"):
            if a.get("content") or a.get("datetime"):
                self.put(a["itemprop"], a.get("content") or a.get("datetime"))
            else:
                self.open.append((tag, a["itemprop"]))
        elif tag == "title":
            self.open.append((tag, "title"))

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        if self.open:
            self.put(self.open[-1][1], data)


def meta_fields(page: str | None) -> dict[str, list[str]]:
    parser = _Meta()
    parser.feed(page or "")
    return parser.found


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def page_fields(pages: pd.Series) -> pd.Series:
    return pages.map(meta_fields)
