"""Command line: ``python -m docmill COMMAND``.  Without a command, ``documents``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pipelines
from .operators import mining
from .sinks import files as sinks
from .sources import files as sources

COMMANDS = ("documents", "transcripts", "report", "queries", "company-queries", "read")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docmill")
    sub = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        one = sub.add_parser(name)
        if name == "queries":
            one.add_argument("--topic", required=True)
            one.add_argument("--from-year", type=int, required=True)
            one.add_argument("--to-year", type=int, required=True)
        else:
            one.add_argument("--input", required=True, help="Parquet table (CSV for company-queries)")
        if name == "documents":
            one.add_argument("--exclude", help="list of domains")
            one.add_argument("--known", help="Parquet table with a column url")
            one.add_argument("--min-words", type=int, default=100)
            one.add_argument("--date-from")
            one.add_argument("--date-to")
            one.add_argument("--preset", choices=tuple(pipelines.PRESETS), default="plain")
        if name == "read":
            one.add_argument("--limit", type=int, default=20)
        else:
            one.add_argument("--output", required=True, help="folder; results go to a folder of their own in it, named by the time")
    return out


def target(folder: str, prefix: str) -> str:
    at = time.strftime("%Y%m%d_%H%M%S")
    return f"{folder.rstrip('/')}/{at}/{prefix}_{at}"


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv.insert(0, "documents")
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "documents":
        config = pipelines.PRESETS[a.preset](pipelines.Config(a.min_words, a.date_from, a.date_to))
        excluded = sources.read_exclusions(spark, a.exclude) if a.exclude else None
        known = spark.read.parquet(a.known) if a.known else None
        docs = pipelines.documents(spark.read.parquet(a.input), excluded, known, config)
        sinks.write_by_year(docs, target(a.output, "documents"))
    elif a.command == "transcripts":
        sinks.write_by_year(pipelines.transcript_documents(spark.read.parquet(a.input)), target(a.output, "transcripts"))
    elif a.command == "report":
        sinks.write_lines(pipelines.report(spark.read.parquet(a.input)).orderBy("first"), target(a.output, "report"), "body")
    elif a.command == "queries":
        sinks.write_lines(mining.expand_queries(spark, a.topic, a.from_year, a.to_year).orderBy("seq"), target(a.output, "queries"), "query")
    elif a.command == "company-queries":
        firms = sources.read_csv(spark, a.input, ("company",))
        ticker = F.col("ticker") if "ticker" in firms.columns else F.lit(None).cast("string")
        sinks.write_lines(mining.company_queries(firms.select("company", ticker.alias("ticker"))), target(a.output, "queries"), "query")
    else:
        rows, n = pipelines.head(spark.read.parquet(a.input), a.limit)
        rows.show(a.limit, truncate=60)
        print(f"{n} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
