"""Readers, writers, parsers and pipelines: round trips and the behaviour that is documented for each."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill import __main__ as cli
from docmill import pipelines
from docmill.functions import contracts, dates, pages, patents, transcripts
from docmill.operators import graph, names, reshape, resolve
from docmill.sinks import files as sinks
from docmill.sources import files as sources
from docmill.streaming import incremental, throttle


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lists_and_exclusions(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# comment\n\n  a b \nHTTPS://www.Reuters.com/x\nreuters.com\n#x\n")
    assert rows(sources.read_list(spark, str(tmp_path / "l.txt"))) == [("a b",), ("HTTPS://www.Reuters.com/x",), ("reuters.com",)]
    assert set(rows(sources.read_exclusions(spark, str(tmp_path / "l.txt")))) == {("a b",), ("reuters.com",)}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿company,country\nA, de \nB,FR\nC,DE\n")
    df = sources.read_csv(spark, str(tmp_path / "c.csv"), ("company", "country"))
    assert rows(sources.page(df, [F.col("company")], 1, 5, ("country", "DE")).select("company")) == [("C",)]
    with pytest.raises(ValueError, match="lei"):
        sources.read_csv(spark, str(tmp_path / "c.csv"), ("lei",))
    (tmp_path / "t.tsv").write_text('"id"\t"name"\t"x"\n"1"\t""\t"z"\n"2"\t"b"\t"z"\n')
    assert rows(sources.read_tsv(spark, str(tmp_path / "t.tsv"), ("id", "name"))) == [("1", None), ("2", "b")]


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xbrl-large.html", "x" * 500)
        z.writestr("report.htm", "日本".encode("shift_jis"))
        z.writestr("note.txt", "y" * 900)
    df = spark.createDataFrame([(1, bytearray(out.getvalue())), (2, bytearray(b"PKbroken")), (3, None)], "id int, content binary")
    assert rows(sources.archive_member(df).orderBy("id")) == [(1, "report.htm", "日本"), (2, None, None), (3, None, None)]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "2024-03-01"), (2, "b", None)], "id int, name string, d string").withColumn("date", F.to_date("d"))
    sinks.append_json(df, str(tmp_path / "j"))
    sinks.append_json(df, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and {x["name"] for x in lines} == {"é", "b"} and {x.get("date") for x in lines} == {"2024-03-01", None}
    sinks.write_by_year(df, str(tmp_path / "y"))
    assert {p.name for p in (tmp_path / "y").iterdir() if p.is_dir()} == {"year=2024", "year=undated"}
    sinks.write_by_key(df, str(tmp_path / "k"), "name")
    assert {r.name for r in spark.read.json(str(tmp_path / "k")).collect()} == {"é", "b"}
    named = sinks.readable_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq int, name string"), "name", "seq", ".pdf")
    assert sorted(r.member for r in named.collect()) == ["a.pdf", "a__2.pdf", "b.pdf"]
    sinks.write_archives(named.withColumn("content", F.lit(b"x")).withColumn("shelf", F.lit(1)), str(tmp_path / "z"), "shelf")
    packed = spark.read.parquet(str(tmp_path / "z")).first().archive
    assert sorted(zipfile.ZipFile(io.BytesIO(packed)).namelist()) == ["a.pdf", "a__2.pdf", "b.pdf"]


def test_dates(spark):
    texts = [("Report of 31 December 2024.",), ("OCTOBER 2025 update",), ("on 2026-01-27",), ("on 15/06/2025",), ("x" * 501 + "2024-01-01",), (None,)]
    got = rows(spark.createDataFrame(texts, "t string").select(dates.date_in_text(F.col("t")).cast("string")))
    assert got == [("2024-12-31",), ("2025-10-01",), ("2026-01-27",), ("2025-06-15",), (None,), (None,)]
    got = rows(spark.createDataFrame([("2024-06",), ("2024",), ("not-a-date",), (None,)], "t string").select(dates.strict_timestamp(F.col("t")).cast("string")))
    assert got == [("2024-06-01 00:00:00",), ("2024-01-01 00:00:00",), (None,), (None,)]
    assert rows(spark.range(1).select(dates.latest(F.to_date(F.lit("2024-12-31")), F.to_date(F.lit("2025-02-24"))).cast("string"))) == [("2025-02-24",)]


PAGE = """<article><h2>Call participants:</h2><ul><li>Ann Bell</li><li> </li></ul><p><strong>Carl Dorn</strong> -- <em>Chief</em></p>
<h2>Prepared Remarks:</h2><p><strong>Operator</strong></p><p>Welcome to a call with <strong>bold</strong> words in a long paragraph of speech.</p><p><strong>Ann Bell</strong> -- <em>CEO</em></p><p>Thanks.</p>
<h2>Questions &amp; Answers:</h2><p><strong>Duration: 0</strong></p><p><strong>Carl Dorn</strong></p><p>And a question.</p></article>"""


def test_transcripts(spark):
    got = transcripts.parse(PAGE)
    assert got["participants"] == ["Ann Bell", "Carl Dorn -- Chief"] and got["speakers"] == ["Ann Bell", "Carl Dorn", "Operator"]
    assert got["prepared"].endswith("Thanks.") and got["questions"].startswith("Duration")
    assert got["prepared"].startswith("Operator\n\nWelcome") and got["prepared"].count("\n\n") == 3
    listed = transcripts.parse("<h2>Prepared Remarks</h2><p>One.</p><ul>\n<li>a</li>\n<li><p>b</p></li></ul><p>Two.</p><h2>Questions &amp; Answers</h2><p>Q?</p>")
    assert (listed["prepared"], listed["questions"]) == ("One.\n\na\nb\n\nTwo.", "Q?")
    assert transcripts.parse(None) == {"participants": [], "speakers": [], "prepared": "", "questions": ""}
    url = "https://www.x.com/earnings/call-transcripts/2024/05/04/berkshire-brk-a-q1-2024-earnings-call-transcript/"
    docs = pipelines.transcript_documents(spark.createDataFrame([(url, PAGE), ("https://x.com/earnings/call-transcripts/2024/05/04/f-x-2024-earnings/", PAGE)], "url string, html string"))
    assert [(r.company, r.title) for r in docs.collect()] == [("BRK.A", "BRK.A Q1 2024")]


def test_pages_of_patents_and_contracts():
    page = '<title>T - X</title><meta name="DC.contributor" scheme="inventor" content="A"><meta name="DC.contributor" scheme="inventor" content="B"><span itemprop="pn">US1</span>'
    assert patents.meta_fields(page) == {"title": ["T - X"], "DC.contributor:inventor": ["A", "B"], "pn": ["US1"]}
    table = "<table><tr><th>Lot size:</th><td>25 t</td></tr><tr><td rowspan='2'>Months</td><td>Jan</td></tr><tr><td>Feb</td></tr><tr><td>Lot size</td><td>50 t</td></tr></table>"
    assert contracts.spec_table(table) == {"lot size": "50 t", "months": "Jan | Feb"}
    fields = "<table><tr><td>Contract Code</td><td>CA</td><td>CB</td></tr><tr><td>Details</td><td>x</td></tr><tr><td rowspan=2>Tick size (USD)</td><td>Outright <b>0.5</b></td></tr><tr><td>Carry</td><td>0.01</td></tr><tr><td>--</td><td>y</td></tr></table>"
    assert contracts.spec_fields(fields, contracts.METAL_LABELS) == {"ticker": "CA | CB", "tick_size__usd": "Outright 0.5 | Carry | 0.01"}
    assert contracts.spec_table(None) == patents.meta_fields("") == {}


def test_two_passes(spark):
    body = "<p>The harbour was dredged on Monday, the council of the town said in a long note.</p>" * 3
    page = f"<html><head><title> A  page </title><style>p{{}}</style><body><nav><a href=/>Home of news</a></nav><div>Outside of the article stand these few words.</div><article><header><h1>Harbour</h1></header>{body}<p><a href=/x>Read more of this in another place</a></p><p>Short.</p></article><footer><p>All of our imprint is here, as ever</p></footer></body></html>"
    title, text, n, method = pages.extract(page, 20)
    assert (title, method) == ("A page", "precision") and text.split("\n")[0] == "Harbour" and "Read more" not in text and "Outside" not in text and "Short." not in text and n == len(text.split())
    wide = pages.extract(page, 200)
    assert wide[3] == "fallback" and "Outside of" in wide[1] and "Short." in wide[1] and "Home of news" not in wide[1]
    assert pages.extract(None) == pages.extract("<script>x</script>") == ("", "", 0, "failed")
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").select("page_id", pages.extraction(F.col("html"), 20).alias("x"))
    assert sorted((r.page_id, r.x.method, r.x.word_count) for r in df.collect()) == [(1, "precision", n), (2, "failed", 0)]
    docs = pipelines.documents(spark.createDataFrame([(1, "https://a.example/x", page)], "page_id long, url string, html string"), config=pipelines.Config(min_words=20)).collect()
    assert [(d.title, d.source) for d in docs] == [("A page", "a.example")] and docs[0].full_text.startswith("Harbour")


def test_links_in_all_forms(spark):
    page = "<A HREF='/a?x=1&amp;y=2'>1</A><a class=k href=/b>2</a><a href=\"/c.PDF\">3</a><a href='/d.woff2?v=1'>4</a><a href='tel:1'>5</a><a data-href='/no'>6</a>"
    pages = spark.createDataFrame([(1, "https://www.example.com/dir/", page)], "page_id long, url string, html string")
    assert {r.link for r in graph.raw_links(pages).collect()} == {"/a?x=1&y=2", "/b", "/c.PDF"}
    assert {r.target for r in graph.resolved_links(pages).collect()} == {"https://www.example.com/a?x=1&y=2", "https://www.example.com/b", "https://www.example.com/c.PDF"}
    assert {r.target for r in graph.internal_links(pages).collect()} == {"https://www.example.com/a", "https://www.example.com/b", "https://www.example.com/c.PDF"}


def test_frontier_and_robots(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/", "<a href='/x'></a><a href='/y'></a><a href='https://b.example.com/z'></a><a href='https://other.org/'></a>")], "page_id long, url string, html string")
    seen, excluded = spark.createDataFrame([("https://a.example.com/y",)], "url string"), spark.createDataFrame([("b.example.com",)], "domain string")
    counts = spark.createDataFrame([("a.example.com", 49)], "host string, n long")
    links = graph.resolved_links(pages)
    assert [r.target for r in graph.frontier(links, seen, excluded, counts, 50).collect()] == ["https://a.example.com/x"]
    assert graph.frontier(links, seen, excluded, counts.withColumn("n", F.lit(50)), 50).count() == 0
    rules = spark.createDataFrame([("a.example.com", "User-agent: *\nDisallow: /private")], "host string, robots string")
    urls = spark.createDataFrame([("https://a.example.com/private/1",), ("https://a.example.com/x",), ("https://none.org/private",)], "url string")
    assert {r.url: r.allowed for r in graph.robots_allowed(urls, rules).collect()} == {"https://a.example.com/private/1": False, "https://a.example.com/x": True, "https://none.org/private": True}


def test_delays_of_other_statuses(spark):
    log = [("a", 1, 429, None), ("a", 2, 404, None), ("b", 1, None, None), ("c", 1, 200, None)]
    df = spark.createDataFrame(log, "domain string, seq long, status int, retry_after double")
    assert {r.domain: r.delay for r in throttle.fold_delays(df).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}
    sync = [("a", 1, 429, None), ("a", 2, 200, None), ("b", 1, 403, None), ("c", 1, 500, None), ("d", 1, 200, None)]
    assert {r.domain: r.delay for r in throttle.fold_sync_delays(spark.createDataFrame(sync, "domain string, seq long, status int, retry_after double")).collect()} == {"a": 2.25, "b": 2.0, "c": 1.5, "d": 1.0}


def test_a_repeated_batch_loses_nothing(spark, tmp_path):
    """As after a failure between the writes and the commit: the commit log of the last batch is gone."""
    source, out, state, at = (str(tmp_path / x) for x in ("in", "out", "state", "cp"))
    for part in ([(1, "a"), (2, "b"), (8, None), (9, None)], [(4, "b"), (5, "c")]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        run = lambda: incremental.ingest(spark, spark.readStream.schema("doc_id long, text string").parquet(source), out, state, at).awaitTermination(120)
        run()
    for number in (1,):
        for name in (f"{number}", f".{number}.crc"):
            (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 5, 8, 9]


def test_names_and_sources(spark):
    left = spark.createDataFrame([("droneshield ltd",), ("acme x corp",), ("zzz",)], "name string")
    right = spark.createDataFrame([("droneshield ltds", 1), ("acme", 2), ("", 3)], "found string, seq int")
    assert {r.name: r.found for r in names.similar_names(left, right).collect()} == {"droneshield ltd": "droneshield ltds", "acme x corp": "acme"}
    none = spark.createDataFrame([], "id long, seq long")
    spare = spark.createDataFrame([(7, 1)], "id long, seq long")
    assert rows(resolve.ids_of_sources([none], spare)) == [(7, 1)]
    assert rows(resolve.ids_of_sources([spare, none], spark.createDataFrame([(8, 1)], "id long, seq long"))) == [(7, 0)]


def test_documents_pipeline_and_command_line(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(120))
    pages = [(1, "https://a.com/1", f"<p>{words}</p>", "2024-05-01"), (2, "https://a.com/1#x", f"<p>{words} x</p>", "2024-05-01"), (3, "https://a.com/3", f"<b>{words}</b>", "2024-05-02"), (4, "https://bad.org/4", f"<p>{words} y</p>", None), (5, "https://a.com/5", "short", None), (6, "https://a.com/6", f"{words} z", "2020-01-01"), (7, "https://a.com/7", f"{words} q", "unknown")]
    spark.createDataFrame(pages, "page_id long, url string, html string, date string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "ex.txt").write_text("bad.org\n")
    assert cli.main(["--input", str(tmp_path / "pages"), "--exclude", str(tmp_path / "ex.txt"), "--date-from", "2024-01-01", "--output", str(tmp_path / "out")]) == 0
    (found,) = (tmp_path / "out").glob("*/documents_*")
    docs = spark.read.parquet(str(found))
    assert sorted(r.link for r in docs.collect()) == ["https://a.com/1", "https://a.com/7"]
    assert cli.main(["queries", "--topic", "gold price", "--from-year", "2023", "--to-year", "2024", "--output", str(tmp_path / "q")]) == 0
    assert spark.read.text(str(next((tmp_path / "q").glob("*/queries_*")))).count() == 53
    body = pipelines.report(docs).first().body
    assert "### Untitled" in body and "| **Words** | 120 |" in body


def test_chunked_documents(spark):
    doc = reshape.to_documents(spark.range(1), full_text=F.lit("a. " * 4000))
    got = reshape.chunked(doc).collect()
    assert "".join(r.full_text for r in got) == "a. " * 4000 and [r.chunk_ix for r in got] == list(range(len(got))) and all(r.date is None for r in got)
