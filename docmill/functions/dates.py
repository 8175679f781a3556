"""Dates in text: strict forms, mixed forms, running text and file metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTHS = "|".join(MONTHS)
#: Forms of a date in running text, in this order; the day comes first, and the month where that is no date.
IN_TEXT = (
    (rf"(?i)(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})", "d MMMM yyyy"),
    (rf"(?i)((?:{_MONTHS})\s+\d{{4}})", "MMMM yyyy"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(\d{1,2}/\d{1,2}/\d{4})", "d/M/yyyy", "M/d/yyyy"),
)


def _first(value: Column, forms: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in forms])


def strict_timestamp(value: Column) -> Column:
    """Four exact forms, then what Spark's own cast reads; else null.  Naive, as in the document table."""
    exact = _first(value, ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy"))
    return F.coalesce(exact, F.try_to_timestamp(value)).cast("timestamp_ntz")


def mixed_timestamp(value: Column) -> Column:
    """ISO 8601 with or without an offset, else usual written forms; in UTC, without zone."""
    value = F.regexp_replace(value, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+", "")
    written = _first(value, ("dd MMM yyyy HH:mm:ss Z", "d MMMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "MM/dd/yyyy"))
    return F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(value), written), F.current_timezone()).cast("timestamp_ntz")


def date_in_text(text: Column, length: int = 500) -> Column:
    """The first form that is there and valid, in the first ``length`` characters; a month alone is its first day."""
    head = F.substring(text, 1, length)
    found = []
    for pattern, *forms in IN_TEXT:
        hit = F.initcap(F.regexp_replace(F.regexp_extract(head, pattern, 1), r"\s+", " "))
        found.append(F.when(hit != "", _first(hit, tuple(forms)).cast("date")))
    return F.coalesce(*found)


def metadata_date(value: Column) -> Column:
    """The first eight digits in a row, as a date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(value, r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def latest(*dates: Column) -> Column:
    """The last of the known ones: what was published, not what it is about."""
    return F.greatest(*dates)


def number_date(value: Column) -> Column:
    """yyyymmdd as a number; 0 and other lengths are null."""
    text = value.cast("string")
    return F.when((value > 0) & (F.length(text) == 8), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
