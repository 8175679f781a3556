"""Files per record, tables in archives, stopping between batches, functions by name, checks across rows."""

import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.functions import registered
from docmill.operators import checks, merging
from docmill.sinks import records
from docmill.sources import zipped
from docmill.streaming import incremental, stopping


def test_a_file_for_each_of_many_records(spark, tmp_path):
    df = spark.range(1001).repartition(5).select(F.concat(F.lit("r_"), F.col("id").cast("string"), F.lit(".md")).alias("f"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("t"))
    records.write_records(df, f"{tmp_path}/out", F.col("f"), F.col("t"))
    names = os.listdir(f"{tmp_path}/out")
    assert len(names) == 1001 and not [n for n in names if n.startswith("_")]
    assert (tmp_path / "out" / "r_7.md").read_text() == "é 7"
    records.write_records(df.limit(1), f"{tmp_path}/out", F.lit("only.bin"), F.lit(b"\x00\x01"), overwrite=True)
    assert os.listdir(f"{tmp_path}/out") == ["only.bin"] and (tmp_path / "out" / "only.bin").read_bytes() == b"\x00\x01"
    assert records.read_records(spark, f"{tmp_path}/out").count() == 1


def test_an_attempt_that_does_not_count_leaves_nothing(tmp_path):
    writer = records.RecordWriter(str(tmp_path), overwrite=False)
    writer.write(iter([("a", "first try"), ("b", "first try")]))  # lost with its executor
    again = writer.write(iter([("a", "second"), ("b", None)]))
    other = writer.write(iter([("c", "third")]))
    assert sorted(os.listdir(tmp_path)) == [os.path.basename(writer.staging)]  # nothing shows before the commit
    writer.commit([again, None, other])
    assert {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)} == {"a": "second", "b": "", "c": "third"}
    broken = records.RecordWriter(str(tmp_path), overwrite=False)
    broken.write(iter([("d", "x")]))
    broken.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]


def test_names_that_clash_or_lead_elsewhere_are_errors(tmp_path):
    writer = records.RecordWriter(str(tmp_path), overwrite=False)
    for bad in ([("a", "1"), ("a", "2")], [("../a", "1")], [("", "1")], [(None, "1")]):
        with pytest.raises(ValueError, match="file"):
            writer.write(iter(bad))
    one, two = writer.write(iter([("a", "1")])), writer.write(iter([("a", "2")]))
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([one, two])
    assert os.listdir(tmp_path) == []


def test_tables_in_archives(spark, tmp_path):
    """Quotes, line ends in fields, empty and missing fields, a mark at the start, other members, several archives."""
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/g_patent.tsv", '﻿"id"\t"note"\t"wide"\n"1"\t"a\tb"\t"w"\n"2"\t""\t"w"\n"3"\t"line\nend ""q"""\t"w"\n4\n'.encode())
        z.writestr("readme.txt", "no table")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("more.TSV", "wide\tnote\tid\nw\tz\t5\n")
    found = zipped.read_zipped(spark, str(tmp_path), ["id", "note"])
    assert sorted(map(tuple, found.collect())) == [("1", "a\tb"), ("2", None), ("3", 'line\nend "q"'), ("4", None), ("5", "z")]
    assert zipped.read_zipped(spark, f"{tmp_path}/one.zip").columns == ["id", "note", "wide"]
    with pytest.raises(Exception, match="lacks"):
        zipped.read_zipped(spark, str(tmp_path), ["id", "none"]).collect()


def test_a_member_is_streamed(spark, tmp_path):
    """A member of 40 MB in blocks: what a task holds is one of them."""
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.tsv", "w", force_zip64=True) as out:
        out.write(b"id\tnote\n")
        for i in range(0, 400_000, 1000):
            out.write("".join(f"{k}\t{'n' * 90}\n" for k in range(i, i + 1000)).encode())
    reader = zipped.ZippedReader(spark.createDataFrame([], "id string").schema, {"path": str(tmp_path)})
    (part,) = reader.partitions()
    first = next(iter(reader.read(part)))
    assert first.num_rows == zipped.BLOCK and first.nbytes < 200_000
    assert zipped.read_zipped(spark, str(tmp_path), ["id"]).agg(F.sum(F.col("id").cast("long"))).first()[0] == 400_000 * 399_999 // 2


def test_stop_and_resume_equal_one_run(spark, tmp_path):
    for k in range(6):
        spark.createDataFrame([(k * 10 + i, f"text {(k * 10 + i) % 23}") for i in range(10)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stop = threading.Event()

    def start(where):
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return incremental.ingest(spark, stream, f"{tmp_path}/{where}", f"{tmp_path}/{where}-state", f"{tmp_path}/{where}-c")

    stop.set()  # asked for before the first batch ends
    assert not stopping.run_until(spark, lambda: start("a"), stop.is_set)
    early = len(incremental.read_ingested(spark, f"{tmp_path}/a", "doc_id long, text string").collect())
    stop.clear()
    assert stopping.run_until(spark, lambda: start("a"), stop.is_set)
    start("b").awaitTermination()
    both = [sorted(map(tuple, incremental.read_ingested(spark, f"{tmp_path}/{w}", "doc_id long, text string").collect())) for w in "ab"]
    assert both[0] == both[1] and len(both[0]) == 23 and early < 23
    assert not stopping.marker(spark, f"{tmp_path}/no")() and stopping.marker(spark, f"{tmp_path}/in")()


def test_functions_by_name(spark):
    names = registered.register(spark)
    assert {"url_key", "content_key", "text_chunks"} <= set(names) and registered.register(spark) == names
    one = spark.sql("SELECT url_key('https://EXAMPLE.com/Page/#x') AS k, date_from_number(0) AS d, floor_percent(1, 0) AS p, us_patent_number('EP1') AS u").first()
    assert tuple(one) == ("https://example.com/page", None, 0, None)
    chunks = spark.sql("SELECT chunk_ix, chunk FROM VALUES ('aaaa. bbbb. cc'), (NULL) AS t(x), LATERAL text_chunks(t.x, 8)").collect()
    assert sorted((r.chunk_ix, r.chunk) for r in chunks) == [(0, ""), (0, "aaaa. "), (1, "bbbb. cc")]


def test_checks_across_rows(spark):
    rows = [(i, f"Own words {i} of this page\nShared footer line\n  Shared footer line two ", "AA", None, None) for i in range(5)]
    rows += [(10, "Same story (NYSE: AA)", "AA", None, 2024), (11, "Same story (NYSE: AA)", "BB", None, 2024), (12, None, None, None, None), (13, "", "BB", None, None), (14, "x (LSE: BB) y", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ticker string, date date, year int")
    got = {r.doc_id: {c for c in checks.CHECKS if r[c]} - {"stub"} for r in checks.quality_suite(df, least=5).collect()}
    assert all(got[i] == {"boilerplate"} for i in range(5))
    assert (got[10], got[11], got[12], got[13], got[14]) == ({"cross_ticker"}, {"cross_ticker", "ticker_mismatch"}, {"empty"}, {"empty"}, set())
    assert checks.quality_suite(df.limit(0)).count() == 0


def test_merged_sources_that_lack_columns(spark):
    """What a source lacks is empty, dates that are none are null, and chunks join to the text."""
    long = "\n\n".join("word " * 300 for _ in range(9))
    a = spark.createDataFrame([("A", "https://a", "soon", long), (None, None, None, None)], "company string, link string, date string, full_text string")
    b = spark.createDataFrame([("B", None, "2024-02-30", "https://b", "text"), ("B", "10-Q", "2024-02-03", "https://c", "")], "company string, form string, filing_date string, url string, full_text string")
    chunks, provenance = merging.merged([(merging.scraped, a, "x/run.parquet"), (merging.agency_filings, b, "sec/f.parquet")])
    rows = chunks.orderBy("link", "chunk_ix").collect()
    assert "".join(r.full_text for r in rows if r.company == "A") == long and max(len(r.full_text) for r in rows) <= 5000
    assert {(r.company, r.title, str(r.date), r.source, r.source_file) for r in rows} == {
        ("A", "", "None", "", "run.parquet"), ("", "", "None", "", "run.parquet"), ("B", " 2024-02-30", "None", "SEC EDGAR ", "sec/f.parquet"), ("B", "10-Q 2024-02-03", "2024-02-03 00:00:00", "SEC EDGAR 10-Q", "sec/f.parquet"),
    }
    assert sorted((r.link, r.source_parquet, r.form, r.words) for r in provenance.collect() if r.form is not None) == [("https://b", "sec/f.parquet", "", 0), ("https://c", "sec/f.parquet", "10-Q", 0)]


def test_costly_pages_of_a_small_table_use_every_core(spark):
    """A table in one small file would be one task."""
    from docmill.plans import parsing

    assert parsing.contract_specs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_in_normal_form_do_not_leave_the_engine(spark):
    """Only texts beyond ASCII go to Python, and only those that change come back."""
    import unicodedata

    from docmill.functions import text

    rows = ["plain\n", "", None, "é", "é ﬁ ①", "x" * 50 + "Ω"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    found = df.select("t", text.nfkc(F.col("t")).alias("n")).collect()
    assert [r.n for r in found] == [None if t is None else unicodedata.normalize("NFKC", t) for t in rows]
    back = df.select(text._composed("t").alias("n")).collect()
    assert [r.n is None for r in back] == [True, True, True, True, False, False]


def test_records_are_written_by_all_cores_and_read_many_to_a_task(spark, tmp_path):
    """Not in as few tasks as their bytes would fill, nor in one for every 32 files."""
    (tmp_path / "out").mkdir()
    df = spark.range(3000).coalesce(1).select(F.concat(F.lit("r_"), F.col("id").cast("string")).alias("f"), F.col("id").cast("string").alias("t"))
    records.write_records(df, f"{tmp_path}/out", F.col("f"), F.col("t"))
    (tmp_path / "out" / "_hidden").write_text("x")
    (tmp_path / "out" / "folder").mkdir()
    found = records.read_records(spark, f"{tmp_path}/out")
    assert found.rdd.getNumPartitions() == 1
    assert {(r.path, bytes(r.content)) for r in found.collect()} == {(f"file:{tmp_path}/out/r_{i}", str(i).encode()) for i in range(3000)}
    assert list(records._runs([("a", 9), ("b", 1), ("c", 1), ("d", 1)], (2, 5))) == [[("a", 9)], [("b", 1), ("c", 1)], [("d", 1)]]
    with pytest.raises(Exception, match="no name for a file"):  # one name meets in one task
        records.write_records(spark.range(2).repartition(2), f"{tmp_path}/again", F.lit("same"), F.col("id").cast("string"))
    (tmp_path / "empty").mkdir()
    assert records.read_records(spark, f"{tmp_path}/empty").count() == 0
