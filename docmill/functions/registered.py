"""The engine's functions by name, for SQL: scalar ones as SQL bodies that Catalyst inlines, table functions for what has rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import pieces

#: name: (parameters, type, body).  Bodies are expressions, so they cost what the built-in functions in them cost.
SCALARS = {
    "url_key": ("url STRING", "STRING", r"regexp_replace(lower(regexp_replace(url, '#[\\s\\S]*', '')), '/+\\z', '')"),
    "url_host": ("url STRING", "STRING", r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"),
    "content_key": ("content STRING", "STRING", "sha2(substring(content, 1, 2000), 256)"),
    "plain_title": ("title STRING", "STRING", "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' '))"),
    "us_patent_number": ("publication STRING", "STRING", r"nullif(regexp_extract(publication, '^US0*(\\d+)', 1), '')"),
    "date_from_number": ("n BIGINT", "DATE", "CASE WHEN n > 0 AND length(n) = 8 THEN CAST(try_to_timestamp(CAST(n AS STRING), 'yyyyMMdd') AS DATE) END"),
    "floor_percent": ("part BIGINT, whole BIGINT", "BIGINT", "CASE WHEN whole > 0 THEN part * 100 div whole ELSE 0 END"),
}


@udtf(returnType="chunk_ix int, chunk string")
class TextChunks:
    """The pieces of a text, each at most ``most`` characters."""

    def eval(self, text: str, most: int = 5000) -> Iterator[tuple[int, str]]:
        yield from enumerate(pieces(text, most))


@udtf(returnType="url string")
class UrlsIn:
    """The http(s) addresses of a field that may hold several."""

    def eval(self, field: str) -> Iterator[tuple[str]]:
        for part in (field or "").replace(";", " ").split():
            part = part.strip(",")
            if part.startswith(("http://", "https://")):
                yield (part,)


#: Table functions, for ``FROM t, LATERAL text_chunks(t.text, 5000)``.
TABLES = {"text_chunks": TextChunks, "urls_in": UrlsIn}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL; their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return sorted([*SCALARS, *TABLES])
