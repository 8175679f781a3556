"""Text functions, as column expressions where built-ins suffice."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# What cleaning deletes, in this order.
_REST = r".*?(\n|\z)"
BOILERPLATE = (
    r"(?i)cookie\s*(policy|consent|preferences|settings)" + _REST,
    r"(?i)(subscribe|sign\s*up)\s*(to\s*(our|the))?\s*newsletter" + _REST,
    r"(?i)share\s*(this\s*)?(on|via)\s*(twitter|facebook|linkedin|x|email)" + _REST,
    r"(?i)all\s*rights?\s*reserved" + _REST,
    r"(?i)(follow|connect\s*with)\s*us\s*(on)?" + _REST,
    r"(?i)\x{a9}\s*\d{4}" + _REST,
    r"(?i)terms\s*(of\s*(use|service)|and\s*conditions)" + _REST,
    r"(?i)privacy\s*policy" + _REST,
    r"(?m)^https?://\S+$",
    r"(?i)(advertisement|sponsored\s*content)",
    r"(?i)claim\s+\d+%\s+off\s+TipRanks\s+Premium" + _REST,
    r"(?i)meet\s+your\s+.*?\s+analyst" + _REST,
    r"(?i)discover\s+how\s+TipRanks" + _REST,
    r"(?i)explore\s+ETFs\s+TipRanks" + _REST,
    r"(?i)learn\s+more\s+about\s+\S+\s+stock\s+on\s+TipRanks" + _REST,
    r"(?i)TipRanks.\s*Stock\s*Analysis\s*page" + _REST,
    r"(?i)unlock\s+hedge\s+fund" + _REST,
    r"(?i)stay\s+ahead\s+of\s+the\s+market\s+with\s+the\s+latest" + _REST,
    r"(?i)make\s+smarter\s+investments\s+with\s+weekly\s+expert" + _REST,
    r"(?i)Smart\s+Investor\s+Newsletter" + _REST,
    r"(?i)trending\s+articles" + _REST,
    r"(?i)related\s+stories" + _REST,
    r"(?i)recommended\s+stories" + _REST,
    r"(?is)(?:MENAFN|Legal\s+Disclaimer)[^\n]*\n?.*?we\s+do\s+not\s+accept\s+any\s+responsibility\s+or\s+liability.*?kindly\s+contact\s+the\s+(?:provider|author)\s+above\.?",
    r"(?is)we\s+do\s+not\s+accept\s*\n?\s*any\s+responsibility\s+or\s+liability.*?kindly\s+contact\s+the\s+(?:provider|author)\s+above\.?",
)


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """NFKC of each text that is not in it; null for the others, so a batch holds one text at a time besides what came and what changed."""

    def of(text: str | None) -> str | None:
        return None if text is None or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)

    return pa.array([of(t.as_py()) for t in texts], pa.string())


def nfkc(text: Column) -> Column:
    """NFKC; a text of ASCII alone is in it and does not leave the engine."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip_boilerplate(text: Column, unicode: bool = True) -> Column:
    """Deletions and white-space rules of cleaning; ``unicode`` as in Python's patterns, else ASCII classes only."""
    flags = "(?Uiud)" if unicode else "(?d)"
    out = reduce(lambda t, p: F.regexp_replace(t, flags + p, ""), BOILERPLATE, F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    return F.regexp_replace(out, r"^\s+|\s+\z", "")


def clean(text: Column) -> Column:
    """NFKC, then :func:`strip_boilerplate`."""
    return strip_boilerplate(nfkc(text))


def words(text: Column) -> Column:
    """Words between white space of any script."""
    return F.coalesce(F.array_remove(F.split(text, r"(?U)\s+"), ""), F.array().cast("array<string>"))


def ascii_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, r"[ \t\n\r\f\x0B]+"), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words; the whole text if it has fewer."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    # The words are bound once: an expression inside the lambda would be split anew for each position.
    return F.element_at(F.transform(F.array(ascii_words(text)), of), 1)


def shingle_hashes(text: Column, size: int = 3) -> Column:
    """Distinct 64-bit hashes of runs of ``size`` words, or of all words if there are fewer; no strings are built."""

    def of(w: Column) -> Column:
        runs = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])), F.lit(1), F.size(w) - size + 1)
        return F.when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(F.array_distinct(runs))

    return F.element_at(F.transform(F.array(ascii_words(text)), of), 1)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def slug(text: Column, length: int = 60) -> Column:
    """Lower case, everything but letters and digits one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), r"^_+|_+\z", ""), 1, length)


def file_slug(text: Column, length: int = 40) -> Column:
    """For file names: separators to underscores, runs squeezed."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[ ./\\:*?\"<>|,;'()-]", "_"), "_+", "_"), r"^_+|_+\z", ""), 1, length)


def snippet(text: Column, length: int = 300) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def lenient_date(value: Column) -> Column:
    """A date from the longest of the usual prefixes; null if none parses."""
    forms = ((19, "yyyy-MM-dd'T'HH:mm:ss"), (19, "yyyy-MM-dd HH:mm:ss"), (10, "yyyy-MM-dd"), (7, "yyyy-MM"), (4, "yyyy"))
    return F.coalesce(*[F.try_to_timestamp(F.substring(value, 1, n), F.lit(f)) for n, f in forms]).cast("date")


def source_tag(name: Column, date: Column, kind: str, as_of: str) -> Column:
    """{slug}_{kind}_{year}Q{quarter}.parquet; undated rows take the quarter of ``as_of``."""
    at = F.coalesce(date, F.to_date(F.lit(as_of)))
    return F.concat(file_slug(name), F.lit(f"_{kind}_"), F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string"), F.lit(".parquet"))


def pieces(text: str | None, size: int = 5000) -> list[str]:
    """Pieces of at most ``size`` characters that join to the text: cut after the last blank line, else the last sentence end, of the second half."""
    out, at, text = [], 0, text or ""
    while len(text) - at > size:
        for mark in ("\n\n", ". "):
            found = text.rfind(mark, at, at + size)
            if found - at >= size // 2:
                end = min(found + 2, at + size)
                break
        else:
            end = at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


@F.pandas_udf(ArrayType(StringType()))
def chunk_text(s: pd.Series) -> pd.Series:
    return s.map(pieces)
