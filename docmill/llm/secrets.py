"""Secret scans by multipart credential linking.  DataFrame operations only.

Base patterns (assignments, access identifiers, long hex runs) are always reported.
Weak candidates, runs that could be a secret but often are not (short hex runs, mixed
base64 runs, values of looser assignments, passwords inside URLs), are reported only
when both complementary parts lie within ``SCOPE`` code points: an access identifier or
user name, and an endpoint.

The interval join works on cells of ``SCOPE`` code points within a document.  For each
cell and role only the least start and the greatest end of the parts that touch it are
kept; that decides exactly whether a part overlaps an interval that reaches into the
cell, so neither pairs nor more than a few rows per candidate arise, even in a document
full of parts.

Patterns that overlap a base span are no candidates.  Nulls and edge cases: a null or empty text has no spans; texts of any length are read
whole; equal rows get equal results; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_spans, find_spans, row_key, shared_checkpoint, table

#: The base patterns.  Letters of the key words count in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A maximal run is matched from its start, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

#: Weak candidates: hex of 16 to 23 characters holding letters and digits, base64-like runs of 32 and more
#: with all of a-z, A-Z and 0-9, and values of looser key words.
WEAK = (
    r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,23}(?![0-9A-Za-z])"
    r"|(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}"
    r"|(?i:\b(?:pwd|pass|passphrase|private_?key|credential|auth)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.-]{6,})"
)
#: A password in an address, after the name of its user; as long as they are.
IN_ADDRESS = r"://[A-Za-z0-9._-]+:([^\s/@:\"'<>]{6,})(?=@[A-Za-z0-9])"
#: Complementary parts.
IDENTIFIER = r"AKIA[A-Z0-9]{16,}|(?i:\b(?:access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,})|(?<=://)[A-Za-z0-9._-]+(?=:[^\s/@:\"'<>]+@)"
ENDPOINT = r"(?i:\b[a-z][a-z0-9+]{1,15}://[^\s\"'<>]{3,}|\b(?:host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,})"
SCOPE = 200

_SPANS = "array<struct<s:int,e:int>>"


def scan(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, row_key, assign, access, hex, weak, identifiers, endpoints (arrays of spans); one pass over the text."""
    text = F.col("text")
    base = docs.select(
        "doc_id", *carry, row_key(F.col("doc_id"), text).alias("row_key"),
        find_spans(text, ASSIGN, group=2, least=ASSIGN_LEAST).alias("assign"), find_spans(text, ACCESS).alias("access"), find_spans(text, HEX).alias("hex"),
        find_spans(text, WEAK).alias("weak"), find_spans(text, IN_ADDRESS, group=1, tail=True).alias("in_address"), text,
    )
    apart = lambda w, *kinds: ~F.exists(F.concat(*kinds), lambda b: (b["s"] < w["e"]) & (b["e"] > w["s"]))
    without = lambda own, *kinds: F.when(F.size(own) == 0, F.col(own)).otherwise(F.filter(own, lambda w: apart(w, *kinds)))
    # A password in an address is one candidate, whatever runs lie in it.
    base = base.withColumn("in_address", without("in_address", *BASE)).withColumn("weak", without("weak", *BASE, "in_address"))
    base = base.withColumn("weak", F.when(F.size("in_address") == 0, F.col("weak")).otherwise(F.array_sort(F.concat("weak", "in_address"))))
    some = F.size("weak") > 0
    return base.select(
        "doc_id", *carry, "row_key", "assign", "access", "hex", "weak",
        find_spans(F.col("text"), IDENTIFIER, keep=some).alias("identifiers"), find_spans(F.col("text"), ENDPOINT, keep=some).alias("endpoints"),
    )


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row_key, linked): the weak candidates with an identifier and an endpoint within ``scope`` code points."""
    rows = scanned.filter((F.size("weak") > 0) & (F.size("identifiers") > 0) & (F.size("endpoints") > 0))
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / scope), F.floor(e / scope)))
    weak = rows.select("row_key", F.explode("weak").alias("w")).distinct()
    weak = weak.select("row_key", "w", cells(F.col("w.s") - scope, F.col("w.e") + scope).alias("cell"))
    parts = rows.select("row_key", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("identifiers").alias("spans")), F.struct(F.lit(1).alias("role"), F.col("endpoints").alias("spans")))).alias("x"))
    parts = parts.select("row_key", "x.role", F.explode("x.spans").alias("p")).select("row_key", "role", "p", cells(F.col("p.s"), F.col("p.e")).alias("cell"))
    parts = parts.groupBy("row_key", "role", "cell").agg(F.min("p.s").alias("first"), F.max("p.e").alias("last"))
    near = (F.col("first") <= F.col("w.e") + scope) & (F.col("last") >= F.col("w.s") - scope)
    met = weak.join(parts, ["row_key", "cell"]).filter(near).groupBy("row_key", "w").agg(F.countDistinct("role").alias("roles"))
    return met.filter("roles = 2").groupBy("row_key").agg(F.array_sort(F.collect_list("w")).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, the columns of ``carry``, row_key, assign, access, hex and linked, arrays of (s, e) in code points.

    Texts are scanned once; what is linked works on the spans.
    """
    scanned = shared_checkpoint(scan(docs, carry))
    found = link(scanned, scope)
    joined = scanned.alias("a").join(found.alias("b"), "row_key", "left")
    return joined.select("doc_id", *carry, "row_key", *BASE, F.coalesce("linked", empty_spans()).alias("linked"))


def _listed(kinds: tuple[str, ...]) -> Column:
    """Spans as kind:start:end by start, then kind as listed, joined by commas."""

    def told(i: int, kind: str) -> Column:
        text = lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), text(x).alias("t")))

    each = [told(i, kind) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["t"]), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed((*BASE, "linked")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; rows and columns stay, n_chars follows the text where there is one."""
    found = find_secrets(docs.select("doc_id", "text"), scope).select("row_key", *BASE, "linked")
    every = F.array_sort(F.concat(*BASE, "linked"))
    hit = found.filter(F.size(every) > 0).select(F.col("row_key").alias("_hit"), every.alias("_spans")).dropDuplicates(["_hit"])
    keyed = docs.withColumn("_row_key", row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(hit, F.col("_row_key") == F.col("_hit"), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["out"], F.array(piece, F.lit(mark)))).otherwise(a["out"]).alias("out"))

    whole = F.aggregate("_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(whole)
    new = {"text": text} | ({"n_chars": F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return joined.withColumns(new).select(*docs.columns)
