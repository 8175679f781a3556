"""Contract pages: classes of assets, specification tables, names."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# Groups of products and words in addresses, each with its class, in order.
GROUPS = {
    "crude oil and refined products": "energy", "natural gas": "energy", "power": "energy", "coal": "energy", "lng": "energy", "agriculture": "agriculture", "softs": "softs", "sugar": "softs",
    "coffee": "softs", "cocoa": "softs", "cotton": "agriculture", "grains and oilseeds": "agriculture", "dairy": "agriculture", "lumber": "agriculture", "emissions": "emissions",
    "environmental": "emissions", "metals": "metals", "battery materials": "metals", "precious metals": "metals", "interest rates": "financials", "equity index": "financials",
    "fx": "financials", "digital assets": "financials", "credit": "financials", "bonds": "financials", "freight": "energy", "electricity": "energy", "biofuels": "energy", "petrochemicals": "energy",
    "msci indices": "financials", "single stock options": "financials", "mini single stocks": "financials", "cross rates": "financials", "emerging markets": "financials", "ftse indices": "financials",
    "swapnotes": "financials", "coindesk indices": "financials", "majors": "financials", "ifus indices": "financials", "ifsg indices": "financials", "ice u.s. dollar index (usdx)": "financials",
    "mortgage rates": "financials", "bitcoin": "financials", "canola": "agriculture", "frozen orange juice": "agriculture",
}
ADDRESS_WORDS = (
    ("energy", ("energy", "oil", "gas", "power")), ("agriculture", ("agriculture", "agri", "sugar", "coffee", "cocoa", "cotton")), ("emissions", ("emission", "carbon")),
    ("metals", ("metal",)), ("financials", ("financial", "interest", "equity", "fx", "index")),
)


def class_of_group(group: Column) -> Column:
    """The class of the group itself, else of the first group that holds it or lies in it; an empty name lies in all."""
    g = F.lower(F.trim(group))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in GROUPS.items()])
    exact = F.try_element_at(F.filter(pairs, lambda p: p["k"] == g), F.lit(1))["v"]
    near = F.try_element_at(F.filter(pairs, lambda p: g.contains(p["k"]) | p["k"].contains(g)), F.lit(1))["v"]
    return F.coalesce(exact, near, F.lit(""))


def class_of_address(url: Column) -> Column:
    out = None
    for name, words in ADDRESS_WORDS:
        hit = F.lower(url).rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


# Labels of specification tables and the fields they fill, of either kind of page, and labels that head a table.
LABELS = {
    "contract symbol": "ticker", "symbol": "ticker", "contract size": "contract_size", "unit of trading": "contract_size", "price quotation": "quote_currency", "currency": "quote_currency",
    "minimum price fluctuation": "tick_size", "minimum tick": "tick_size", "tick size": "tick_size", "tick value": "tick_size", "contract months": "trading_months", "contract series": "trading_months",
    "listed contracts": "trading_months", "settlement": "settlement_type", "settlement method": "settlement_type", "delivery": "settlement_type", "last trading day": "last_trade_date_rule",
    "last trade date": "last_trade_date_rule", "expiration": "last_trade_date_rule", "trading hours": "trading_hours", "trading period": "trading_hours",
}
METAL_LABELS = {
    "contract code": "ticker", "lot size": "contract_size", "deliver type": "settlement_type", "delivery type": "settlement_type", "price quotation": "quote_currency", "contract period": "trading_months",
    "termination of trading": "last_trade_date_rule",
}
HEADS = ("specification", "details", "description")


class _Specs(HTMLParser):
    """Rows of two cells and more: label and value; a row without a label goes on with the one above.

    Pieces of a cell are joined by a space, cells of a value by a bar.
    """

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, str] = {}
        self.cells: list[str] | None = None
        self.inside, self.spans, self.last = False, 0, ""

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
            self.inside = True
            if len(self.cells) == 1 and self.spans == 0:
                span = dict(attrs).get("rowspan") or "1"
                self.next = int(span) if span.isdigit() else 1

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.inside = False
        elif tag == "tr" and self.cells:
            cells = [" ".join(c.split()) for c in self.cells]
            if self.spans > 0:
                self.spans -= 1
                value = " | ".join(c for c in cells if c)
                if self.last and value:
                    self.found[self.last] = f"{self.found[self.last]} | {value}" if self.found.get(self.last) else value
            elif len(cells) > 1 and cells[0]:
                self.last = cells[0].rstrip(":").strip().lower()
                self.found[self.last] = " | ".join(c for c in cells[1:] if c)
                self.spans = max(0, getattr(self, "next", 1) - 1)
            self.cells = None

    def handle_data(self, data):
        if self.inside and self.cells:
            self.cells[-1] += f" {data}"


def spec_table(page: str | None) -> dict[str, str]:
    """Label to value; a repeated label keeps its last value, spanned rows join theirs."""
    parser = _Specs()
    parser.feed(page or "")
    return parser.found


def spec_fields(page: str | None, labels: dict[str, str], heads: tuple[str, ...] = HEADS) -> dict[str, str]:
    """Fields of a contract by the labels that name them; other labels, cleaned, name themselves.  Of two labels of a field the last counts."""
    out = {}
    for label, value in spec_table(page).items():
        name = labels.get(label) or re.sub(r"[^a-z0-9_]", "_", label).strip("_")
        if label not in heads and name:
            out[name] = value
    return out


def fields_of(pages: Column, labels: dict[str, str] = LABELS) -> Column:
    """The fields of specification pages as a map."""

    @F.pandas_udf(MapType(StringType(), StringType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda page: spec_fields(page, labels))

    return run(pages)


@F.pandas_udf(MapType(StringType(), StringType()))
def specs(pages: pd.Series) -> pd.Series:
    return pages.map(spec_table)


def first_of(fields: Column, keys: tuple[str, ...]) -> Column:
    """The first of several keys of a map that has a value."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def without(fields: Column, keys: tuple[str, ...]) -> Column:
    """What is left of a map: keys cleaned, empty values out."""
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*keys) & (F.coalesce(v, F.lit("")) != ""))
    return F.transform_keys(rest, lambda k, v: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), r"^_+|_+\z", ""))


def product_name(title: Column, heading: Column, url: Column) -> Column:
    """The title without what follows a bar or dash, else the heading, else the last part of the address in words."""
    short = F.trim(F.regexp_replace(title, r"\s+[|–-]\s+.*$", ""))
    tail = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "[?#].*", ""), r"/+\z", ""), r"([^/]+)\z", 1)
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(F.trim(heading), F.lit("")), F.initcap(F.regexp_replace(tail, "[-_]+", " ")))
