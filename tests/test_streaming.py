"""Streams over small files give what the batch forms give."""

from folioscope.sources import elements
from folioscope.sources.elements import numbered_pages
from folioscope.streaming.documents import process_new_documents, usage_windows

SF = "/root/testdata/sf0.001"


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(40).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for _ in range(2):  # the second call finds nothing new
        process_new_documents(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == docs.limit(40).select("source").distinct().count()


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = usage_windows(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM usage").first().n == events.count()


def test_pages_go_on_in_a_later_batch_and_replays_write_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    first = docs.select("source").first().source
    own = docs.filter(docs.source == first).orderBy("doc_id")
    ids = [r.doc_id for r in own.collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for part in (ids[:1], ids[1:]):
        own.filter(own.doc_id.isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        process_new_documents(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    pages = {r.batch: r.pages for r in spark.read.parquet(str(tmp_path / "out_pages")).collect()}
    assert pages == {0: 1, 1: len(ids) - 1}
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch", "doc_key").count().filter("count > 1").count() == 0
    before = spark.createDataFrame([(first, 1)], "source string, pages long")
    later = numbered_pages(own.filter(own.doc_id.isin(ids[1:])), before)
    assert {r.doc_id: r.page_num for r in later.collect()} == {d: k + 1 for k, d in enumerate(ids) if k}


def test_pages_are_counted_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(elements, "PAGE_RANGE", 7)
    rows = [(k * 3 % 101, "t", "ab"[k % 3 == 0]) for k in range(90)] + [(None, "t", "a"), (500, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.source, r.doc_id): r.page_num for r in numbered_pages(docs).collect()}
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(-1 if i is None else i)
    assert got == {(s, None if i == -1 else i): k for s, own in by.items() for k, i in enumerate(sorted(own), 1)}
