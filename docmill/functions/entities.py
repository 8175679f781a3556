"""Names of organisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms.
FORMS = r"LLC|L\.L\.C\.|Inc\.?|Incorporated|Corp\.?|Corporation|Ltd\.?|Limited|GmbH|AG|S\.A\.|SA|S\.r\.l\.|Co\.?|Company|PLC|Pty|NV|BV|SE|KG|OHG|LP|L\.P\."
SEARCH_FORMS = r"Inc|Corp|Co|Ltd|Plc|LLC|LP|NV|SA|SE|AG|Group|Holdings?|International|Brands?|Enterprises?"
GUARD_FORMS = r"plc|p\.l\.c\.?|ltd|limited|holdings|group|the"
PASSES = 3


def normal_assignee(name: Column) -> Column:
    """Up to three legal forms off the end, lower case."""
    once = lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, rf"(?i),?\s*\b({FORMS})\s*\z", "")), r"\s*,+\s*\z", "")
    return F.lower(reduce(lambda t, _: once(t), range(PASSES), F.trim(F.coalesce(name, F.lit("")))))


def search_name(name: Column) -> Column:
    short = F.trim(F.regexp_replace(name, rf"(?i)\s*\b({SEARCH_FORMS})\.?\s*\z", ""))
    return F.when(F.length(short) > 1, short).otherwise(name)


def guard_tokens(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(name), rf"\b({GUARD_FORMS})\b", "")
    return F.array_remove(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), "")


def name_guard(wanted: Column, found: Column) -> Column:
    """The first token of the wanted name is there, and at least half of its distinct tokens."""
    a, b = guard_tokens(wanted), guard_tokens(found)
    share = F.size(F.array_intersect(a, b)) * 2 >= F.size(F.array_distinct(a))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & F.array_contains(b, F.try_element_at(a, F.lit(1))) & share, F.lit(False))
