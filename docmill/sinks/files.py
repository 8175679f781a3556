"""Writers: JSON lines, Markdown, year and key partitions, archives, reference lists."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_words, slug
from ..operators.select import spread_numbers


def append_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; characters stay as they are, dates are text."""
    dates = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if f.dataType.typeName().startswith(("timestamp", "date"))}
    df.withColumns(dates).write.mode("append").json(path)


def write_by_year(df: DataFrame, path: str, date: str = "date") -> None:
    """Partitions by year; rows without a date go to undated."""
    df.withColumn("year", year_of(F.col(date))).write.mode("overwrite").partitionBy("year").parquet(path)


def year_of(date: Column) -> Column:
    return F.coalesce(F.year(date).cast("string"), F.lit("undated"))


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder of JSON lines per key."""
    df.withColumn("_folder", slug(F.coalesce(key, F.lit("")))).write.mode("append").partitionBy("_folder").json(path)


def markdown_article(title: Column, source: Column, link: Column, date: Column, text: Column, query: Column | None = None, level: int = 1) -> Column:
    """One record: heading, a table of what is known, and the text."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    row = lambda name, c: F.when(~blank(c), F.concat(F.lit(f"| **{name}** | "), c, F.lit(" |")))
    words = F.concat(F.lit("| **Words** | "), F.format_number(F.size(ascii_words(F.coalesce(text, F.lit("")))), 0), F.lit(" |"))
    heading = F.concat(F.lit("#" * level + " "), F.when(blank(title), F.lit("Untitled")).otherwise(title))
    table = F.concat_ws("\n", F.lit("| | |"), F.lit("|---|---|"), row("Source", source), row("URL", link), row("Date", date), words, *([row("Query", query)] if query is not None else []))
    return F.concat_ws("\n", heading, F.lit(""), table, F.lit(""), F.when(~blank(text), text), F.lit(""))


def markdown_groups(df: DataFrame, group: str, seq: str, article: Column) -> DataFrame:
    """(group, first, n, body): the articles of each group under its heading, in order; groups sort by first.

    Counts and order are per group, so a report is a sorted write of these rows.
    """
    rows = df.select(F.coalesce(F.col(group), F.lit("")).alias(group), F.col(seq).alias("_seq"), article.alias("_a"))
    out = rows.groupBy(group).agg(F.min("_seq").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_seq", "_a"))).alias("_xs"))
    body = F.array_join(F.transform("_xs", lambda x: x["_a"]), "\n")
    heading = F.when(F.col(group) != "", F.concat(F.lit("## "), F.col(group), F.lit("\n\n"))).otherwise("")
    return out.select(group, "first", "n", F.concat(F.lit("---\n\n"), heading, body).alias("body"))


def record_names(df: DataFrame, title: Column, seq: str) -> DataFrame:
    """``df`` with file: slug_001.md and so on, counted per slug; from 1,000 on with as many digits as the number has."""
    named = df.withColumn("_slug", slug(F.coalesce(title, F.lit("")), 40))
    numbered = spread_numbers(named, [F.col("_slug")], [F.col(seq)], "_at")
    digits = F.col("_at").cast("string")
    return numbered.withColumn("file", F.concat("_slug", F.lit("_"), F.when(F.col("_at") < 1000, F.lpad(digits, 3, "0")).otherwise(digits), F.lit(".md"))).drop("_slug", "_at")


def artefact_name(url: Column, name: Column) -> Column:
    return F.concat(F.substring(F.sha2(url, 256), 1, 8), F.lit("_"), name)


def readable(title: Column, length: int = 80) -> Column:
    """A title as a file name: what files can't hold goes, white space becomes one space."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " ")
    return F.regexp_replace(F.substring(F.trim(plain), 1, length), r"[ .]+\z", "")


def readable_names(df: DataFrame, name: str, seq: str, ending: str) -> DataFrame:
    """``df`` with member: the name, the second of a kind with __2, the third with __3."""
    at = F.col("_at")
    numbered = spread_numbers(df, [F.col(name)], [F.col(seq)], "_at")
    return numbered.withColumn("member", F.concat(F.col(name), F.when(at > 1, F.concat(F.lit("__"), at.cast("string"))).otherwise(""), F.lit(ending))).drop("_at")


def write_archives(df: DataFrame, path: str, shelf: str) -> None:
    """One ZIP per shelf (a bounded bundle, by choice of the column), as a binary column of a table: members and content of each shelf in one task."""

    def pack(rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, content in sorted(zip(rows["member"], rows["content"], strict=True)):
                z.writestr(member, content)
        return rows[[shelf]].head(1).assign(archive=out.getvalue())

    df.select(shelf, "member", "content").groupBy(shelf).applyInPandas(pack, df.select(shelf).schema.add("archive", "binary")).write.mode("overwrite").parquet(path)


def letters(n: Column, most: int = 7) -> Column:
    """1 is a, 26 is z, 27 is aa and so on; up to ``most`` letters."""
    out, left = F.lit(""), n.cast("long")
    for _ in range(most):
        out = F.when(left > 0, F.concat(F.char(F.lit(97) + (left - 1) % 26), out)).otherwise(out)
        left = F.floor((left - 1) / 26)
    return out


def citekeys(df: DataFrame, authors: Column, year: str, title: Column, seq: str) -> DataFrame:
    """``df`` with citekey: surname, year and first word of the title; further ones of a kind get b, c and so on to z, then -a, -b, ..., -aa.

    Keys are unique: a letter that would make another row's plain key is passed over.
    """
    first = F.trim(F.element_at(F.split(F.coalesce(authors, F.lit("")), ","), 1))
    surname = F.regexp_replace(F.element_at(F.split(first, r"\s+"), -1), "[^A-Za-z]", "")
    surname = F.when(first == "", "anon").otherwise(F.lower(surname))
    word = F.element_at(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " ")), " "), 1)
    base = F.concat(surname, F.substring(F.coalesce(F.col(year).cast("string"), F.lit("nd")), 1, 4), F.when(word == "", "x").otherwise(word))
    numbered = spread_numbers(df.withColumn("_base", base), [F.col("_base")], [F.col(seq)], "_at")
    kinds = numbered.groupBy("_base").agg(F.max("_at").alias("_n"))
    taken = kinds.select(F.regexp_replace("_base", ".$", "").alias("_base"), (F.ascii(F.right("_base", F.lit(1))) - 96).alias("letter")).filter(F.col("letter").between(2, 26))
    taken = taken.join(kinds.filter("_n > 1").select("_base"), "_base", "left_semi").groupBy("_base").agg(F.collect_set("letter").alias("_taken"))
    free = F.filter(F.sequence(F.lit(2), F.lit(26)), lambda i: ~F.array_contains(F.coalesce("_taken", F.array().cast("array<int>")), i))
    at = F.col("_at")
    some = F.when(at == 1, "").when(at - 1 <= F.size(free), letters(F.get(free, (at - 2).cast("int")))).otherwise(F.concat(F.lit("-"), letters(at - 1 - F.size(free))))
    return numbered.join(taken, "_base", "left").withColumn("citekey", F.concat("_base", some)).drop("_base", "_at", "_taken")


def _plain(value: Column) -> Column:
    """Without braces, and for ampersands."""
    return F.replace(F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[{}]", ""), F.lit("&amp;"), F.lit("and")), F.lit("&"), F.lit("and"))


def bibtex(key: Column, authors: Column, title: Column, year: Column, venue: Column, doi: Column, arxiv: Column, link: Column) -> Column:
    """One entry: author, title and year always, the rest where it is known; a preprint number counts where no venue does, and makes a @misc."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    names = F.array_join(F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != ""), " and ")
    venue = _plain(venue)
    preprint = ~none(arxiv) & (venue == "")
    line = lambda name, value, there=None: (lambda x: x if there is None else F.when(there, x))(F.concat(F.lit(f"  {name:<9} = {{"), value, F.lit("}")))
    lines = [
        line("author", names), line("title", _plain(title)), line("year", F.substring(F.coalesce(year.cast("string"), F.lit("")), 1, 4)), line("journal", venue, venue != ""), line("doi", doi, ~none(doi)),
        line("eprint", arxiv, preprint), F.when(preprint, F.lit("  archivePrefix = {arXiv}")), line("url", link, ~none(link)),
    ]
    return F.concat(F.when(preprint, "@misc{").otherwise("@article{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def reference_line(key: Column, authors: Column, title: Column, year: Column, venue: Column, source: Column, doi: Column, arxiv: Column) -> Column:
    """A line of a reference list: at most three authors of more than four, then year, title, venue or else source, and a number."""
    known = lambda c: F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    names = F.coalesce(known(authors), F.lit("Anon."))
    parts = F.split(names, ",")
    names = F.when(F.size(parts) > 4, F.concat(F.array_join(F.slice(parts, 1, 3), ","), F.lit(", et al."))).otherwise(names)
    tail = F.when(known(doi).isNotNull(), F.concat(F.lit(" doi:"), doi)).when(known(arxiv).isNotNull(), F.concat(F.lit(" arXiv:"), arxiv)).otherwise("")
    return F.concat(F.lit("- ["), key, F.lit("] "), names, F.lit(" ("), F.substring(F.coalesce(known(year), F.lit("n.d.")), 1, 4), F.lit("). *"), F.trim(F.coalesce(title, F.lit(""))), F.lit("*. "), F.coalesce(known(venue), known(source), F.lit("")), F.lit("."), tail)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
