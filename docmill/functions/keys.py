"""Keys of URLs and contents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host with its port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def base_domain(name: Column) -> Column:
    """The last two labels of a host name."""
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(name)


def url_key(url: Column) -> Column:
    """Without fragment, lower case, without any trailing slashes."""
    return F.regexp_replace(F.lower(F.regexp_replace(url, r"#[\s\S]*", "")), r"/+\z", "")


def url_hash(url: Column) -> Column:
    return F.sha2(url_key(url), 256)


def content_hash(text: Column, length: int = 2000) -> Column:
    """Digest of the first ``length`` code points."""
    return F.sha2(F.substring(text, 1, length), 256)
