"""Documents in pieces of a page against the same documents in one row."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA

from folioscope.operators import enforce, language, pieces, validate
from folioscope.plans import document

#: Documents by pages: markers in texts, tables and line ends at page ends, headings from level 2, other scripts, gaps, no marker at all.
PAGES = {
    "a": {1: "## Two\n\n| a | long cell |\n|---|---|\n| x |", 2: "| b |\n| c | d |\n\n\n\n\n", 3: "### Three \r\nend-\nof it seems that \n# \n\n"},
    "b": {2: "Это русский текст и другое\n#### x\n[uncertain: y]\n", 9: "the and of\n" + "z" * 600 + "\n| cut\n<!-- page: 4 -->\n"},
    "c": {-2: "## Page 7\n\n\nthe text\n", -1: "##  Page 8"},
    "d": {-1: "plain and the rest\n"},
    "e": {},
    "f": {1: "   \t\n\n\n\n\r\n", 2: ""},
}
METADATA = [("a", "f.pdf", 'A "title"\n## of lines'), ("b", None, None), ("c", "c", "t"), ("d", "d", "t\n---\n| x |"), ("e", "e", "e"), ("f", "f", None)]


def whole_and_pieces(spark):
    rows = [(k, p, f"\n<!-- page:{p} -->\n\n{t}") for k, own in PAGES.items() for p, t in own.items()]
    pages = spark.createDataFrame(rows, "doc_key string, page_num long, md string")
    fields = spark.createDataFrame(METADATA, "doc_key string, source_file string, title string")
    texts = spark.createDataFrame([(k, "".join(t for n, _, t in sorted(rows) if n == k)) for k in PAGES], "doc_key string, md string")
    return pages, fields, enforce.enforce(texts.join(fields, "doc_key"), "doc_key"), texts


def test_pieces_give_what_whole_texts_give(spark):
    pages, fields, whole, texts = whole_and_pieces(spark)
    made = enforce.enforce_pieces(pages, enforce.documents_of(pages, fields, "doc_key", "page_num"), "doc_key", "page_num").localCheckpoint()
    rows = {r.doc_key: r.md for r in whole.collect()}
    assert {r.doc_key: r.md for r in pieces.joined(made, "page_num").collect()} == rows
    assert "# Two" in rows["a"].split("\n") and "<!-- page:7 -->" in rows["c"] and "<!-- page:1 -->" in rows["d"]
    assert {r.doc_key: (r.md5, r.n) for r in pieces.digests(made, "doc_key", "page_num").collect()} == {k: (hashlib.md5(t.encode()).hexdigest(), len(t)) for k, t in rows.items()}
    reports = validate.report(whole, "doc_key")
    old = {r.doc_key: r.asDict() for r in reports.join(validate.gate(whole, reports, "doc_key"), "doc_key").collect()}
    facts = validate.report_pieces(made, "doc_key", "page_num")
    assert {r.doc_key: r.asDict() for r in facts.drop("content_lines").join(validate.gated(facts, "doc_key"), "doc_key").collect()} == old
    assert len({r["warnings"] for r in old.values()}) > 2
    said = {r.doc_key: r.asDict() for r in language.detect(texts, "md", ["doc_key"]).filter("doc_key <> 'e'").collect()}
    assert {r.doc_key: r.asDict() for r in language.detect_pieces(pages, "doc_key", "page_num").collect()} == said
    assert said["b"]["script"] in ("latin", "cyrillic")


@pytest.mark.parametrize("n", [3, 40])
def test_no_row_holds_a_document(spark, n):
    """A document's rows have the size of its pages, however many there are."""
    rows = [("d", p, k, "text", f"line {k} of page {p} goes on here", 0.0, 100.0 + k, 90.0, 110.0 + k, 100.0 + k, 12.0, 0.9) for p in range(1, n + 1) for k in range(5)]
    processed = document.process_elements(spark.createDataFrame(rows, SCHEMA))
    texts, documents = document.render_pieces(processed)
    assert texts.count() == n + 1 and texts.agg(F.max(F.length("md"))).first()[0] < 700 and "md" not in documents.columns
    digest = document.markdown_digests(spark.createDataFrame(rows, SCHEMA)).first()
    md = document.render_markdown(processed).first().md
    assert (digest.md5, digest.n) == (hashlib.md5(md.encode()).hexdigest(), len(md))
