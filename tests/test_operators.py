"""Operators on small element tables."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import confidence, language, layout, links, noise, regions, render, state, validate
from folioscope.plans import document
from folioscope.sources import adapters

SCHEMA = "doc_key string, page_num long, elem_idx long, elem_type string, content string, x0 double, y0 double, x1 double, y1 double, y double, font_size double, confidence double"


def page(spark, rows):
    """rows: (page, type, content, x0, y0, height, font, confidence)."""
    return spark.createDataFrame([("d", p, k, t, c, x, y, x + 100.0, y + h, y, f, q) for k, (p, t, c, x, y, h, f, q) in enumerate(rows)], SCHEMA)


def test_noise_patterns(spark):
    texts = ["Page 3 of 9", "3 / 9", "- 4 -", "[ 5 ]", "7", "pg. 8", "CONFIDENTIAL - internal", "Draft copy", "Copyright © 2020 x", "www.a.com", "|||===", "ab", "aaaaab", "xbcdfgx", "A plain line"]
    rows = page(spark, [(1, "text", t, 0.0, 300.0, 10.0, 12.0, 0.9) for t in texts])
    got = {r.content: r.noise_type for r in noise.tag_noise(rows).collect()}
    assert [got[t] for t in texts] == ["page_number"] * 6 + ["watermark"] * 4 + ["artifact"] * 4 + [None]


def test_repeating_heads(spark):
    rows = [(p, "text", t, 0.0, y, 10.0, 12.0, 0.9) for p in (1, 2, 3) for t, y in (("Annual Report", 10.0), (f"body of page {p} goes here", 400.0), (f"Volume {p} end", 780.0))]
    got = {(r.page_num, r.content): r.noise_type for r in noise.tag_noise(page(spark, rows)).collect()}
    assert got[1, "Annual Report"] == "header" and got[2, "Volume 2 end"] == "footer" and got[3, "body of page 3 goes here"] is None
    report = noise.noise_report(page(spark, rows)).first()
    assert report.headers_detected == 4 and report.distinct_headers == 1
    two = page(spark, [r for r in rows if r[0] < 3])
    assert noise.tag_noise(two).filter("noise_type in ('header', 'footer')").count() == 0
    assert noise.remove_headers_footers(page(spark, rows)).filter("content = 'Annual Report'").count() == 0


@pytest.mark.parametrize("edges,columns", [([50.0], 1), ([50.0, 350.0], 2), ([50.0, 270.0, 490.0], 3), ([50.0, 100.0], 1)])
def test_columns(spark, edges, columns):
    rows = page(spark, [(1, "text", f"t{k}", edges[k % len(edges)], 500.0 - 20 * k, 10.0, 12.0, 0.9) for k in range(6)])
    assert layout.detect_columns(rows).count() == columns
    ordered = layout.reading_order(layout.assign_columns(rows)).orderBy("reading_order").collect()
    assert [r.reading_order for r in ordered] == list(range(1, 7))
    assert all(a.y0 <= b.y0 for a, b in zip(ordered, ordered[1:], strict=False) if a.column_id == b.column_id)


def test_layout_roles(spark):
    rows = page(spark, [(1, "text", "ALL CAPS HEADING", 50.0, 40.0, 30.0, 20.0, 0.9), (1, "text", "A paragraph that is long enough to be a paragraph. " * 5, 50.0, 120.0, 12.0, 12.0, 0.9), (1, "text", "Figure 1: caption", 50.0, 150.0, 12.0, 12.0, 0.9), (1, "text", "- item", 50.0, 170.0, 12.0, 12.0, 0.9), (1, "text", "10. Tenth", 50.0, 190.0, 12.0, 12.0, 0.9), (1, "text", "unsure", 50.0, 60.0, 12.0, 12.0, 0.55)])
    got = {r.elem_idx: r for r in layout.page_layout(rows).collect()}
    assert [got[k].semantic_role for k in range(6)] == ["heading", "paragraph", "caption", "list_item", "list_item", "paragraph"]
    assert got[5].uncertain and got[5].reading_order == 6 and got[0].role_confidence >= 0.6


def test_captions(spark):
    rows = page(spark, [(1, "text", "Table 1: First", 0.0, 90.0, 10.0, 12.0, 0.9), (1, "table", "| a |", 0.0, 100.0, 50.0, None, None), (1, "text", "Tbl. 2 Second", 0.0, 130.0, 10.0, 12.0, 0.9), (1, "figure", "[Figure]", 0.0, 600.0, 50.0, None, None), (1, "text", "Fig 3. Far away", 0.0, 300.0, 10.0, 12.0, 0.9)])
    out = {r.elem_idx: r for r in links.extract_captions(rows).collect()}
    assert set(out) == {1, 3} and (out[1].caption, out[1].caption_number) == ("Second", 2) and out[3].caption is None
    assert {r.elem_idx for r in links.extract_captions(rows, keep_unlinked=True).collect()} == {1, 3, 4}


def test_footnotes(spark):
    rows = page(spark, [(1, "text", t, 0.0, y, 10.0, 12.0, 0.9) for t, y in (("[1] A note", 700.0), ("(2) Another", 710.0), ("3. Third one", 720.0), ("² Raised", 730.0), ("[4] too high", 100.0), ("see [1] and [9]", 50.0))])
    got = {r.elem_idx: (r.footnote_id, r.footnote_text) for r in links.footnotes(rows).collect()}
    assert got == {0: ("1", "A note"), 1: ("2", "Another"), 2: ("3", "Third one"), 3: ("2", "Raised")}
    marked = {r.elem_idx: r.footnote_id for r in links.mark_footnotes(rows).filter("footnote_role is not null").collect()}
    assert marked == {0: "1", 1: None, 2: "3", 3: None}
    refs = {(r.ref, r.has_content) for r in links.footnote_refs(rows).filter("elem_idx = 5").collect()}
    assert refs == {("1", True), ("9", False)}


def test_confidence(spark):
    values = [(1, 0.95), (1, 0.88), (1, 0.65), (1, 0.92), (2, 0.78), (2, 0.45), (2, 0.91)]
    rows = page(spark, [(p, "text", "x", 0.0, 10.0 * k, 5.0, 12.0, c) for k, (p, c) in enumerate(values)])
    stats = confidence.statistics(rows).first()
    assert (stats.avg, stats.min, stats.max, stats.median, stats.uncertain_count, stats.low_confidence_count) == (0.7914, 0.45, 0.95, 0.88, 2, 1)
    empty = confidence.statistics(rows.limit(0), spark.createDataFrame([("e",)], "doc_key string")).first()
    assert (empty.avg, empty.std_dev, empty.total_elements) == (1.0, 0.0, 0)
    assert confidence.overall(confidence.statistics(rows)).first().score == 0.7077
    assert confidence.grouping_sets(rows).count() == 1 + 2 + 1 + 1
    assert [r.element_id for r in confidence.records(rows).orderBy("page_num", "element_id").limit(1).collect()] == ["elem_1_1"]


@pytest.mark.parametrize(
    "text,language_",
    [
        ("The quick brown fox jumps over the lazy dog and it is in the house.", "en"),
        ("Der schnelle Fuchs springt über den Hund und die Katze mit der Maus.", "de"),
        ("မြန်မာဘာသာသည် မြန်မာနိုင်ငံ၏ ဘာသာစကား", "my"),
        ("这是一个中文句子用来测试语言", "zh"),
        ("これは日本語のテスト文章です漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字", "ja"),
        ("short", "en"),
        ("Съешь ещё этих мягких булок", "ru"),
    ],
)
def test_language(spark, text, language_):
    rows = spark.createDataFrame([(1, text)], "k int, t string")
    assert language.detect(rows, "t", ["k"]).first().language == language_


def test_rendering(spark):
    rows = page(spark, [(1, "text", "Introduction", 0.0, 300.0, 10.0, 18.0, 0.95), (1, "text", "Some plain words follow here", 0.0, 310.0, 10.0, 12.0, 0.65), (1, "text", "• bullet", 0.0, 320.0, 10.0, 12.0, 0.4), (1, "table", "| a |", 0.0, 330.0, 10.0, None, None), (1, "figure", "z", 0.0, 340.0, 10.0, None, None)])
    md = render.annotate_document(rows).first().md
    assert md == (
        "\n<!-- page:1 -->\n\n<!-- role:heading level:2 -->\n## Introduction\n\n<!-- role:paragraph -->\n<!-- confidence:0.65 -->\n[uncertain: Some plain words follow here]\n\n"
        "<!-- role:list_item type:unordered -->\n<!-- confidence:0.40 -->\n[low-confidence: • bullet]\n\n<!-- role:table -->\n| a |\n\n<!-- role:figure -->\n![Figure](image)\n\n"
    )


def test_validation(spark):
    good = '---\ndocument:\n  source_file: "a"\n  document_id: "b"\nquality:\n  x: 1\n---\n<!-- page:1 -->\n<!-- role:heading level:1 -->\n# T\n\nline one\nline two\nline three\nline four\n'
    bad = "It appears that this is short\n```\n[x]()"
    df = spark.createDataFrame([(1, good), (2, bad)], "k int, md string")
    got = {r.k: r for r in validate.report(df, "k").collect()}
    assert got[1].errors == 0 and got[1].quality_score == 1.0 and got[2].hallucination_count == 1 and got[2].is_valid
    assert not validate.report(df, "k", strict=True).filter("k = 2").first().is_valid
    gates = {r.k: r for r in validate.gate(df, validate.report(df, "k"), "k").collect()}
    assert gates[1].passed and gates[2].suggested_action == "fallback_to_local_ocr"
    syntax = {r.k: r for r in validate.syntax(df, "k").collect()}
    assert syntax[1].syntax_valid and not syntax[2].syntax_valid and syntax[2].empty_links == 1 and syntax[2].unclosed_code


@pytest.mark.parametrize("words,expected,verdict", [(50, None, "possibly_incomplete"), (300, None, "ok"), (700, None, "possibly_excessive"), (20, 1000, "possibly_incomplete"), (900, 1000, "ok")])
def test_completeness(spark, words, expected, verdict):
    df = spark.createDataFrame([(1, "w " * words)], "k int, md string")
    assert validate.completeness(df, "k", F.lit(1), F.lit(expected).cast("long")).first().verdict == verdict


def test_confidence_markers(spark):
    df = spark.createDataFrame([(1, "<!-- confidence:0.65 -->\n[uncertain: a]\n<!-- confidence:0.45 -->\nb")], "k int, md string")
    row = validate.confidence_markers(df, "k").first()
    assert (row.low_confidence_count, row.min_confidence, row.avg_low_confidence, row.uncertain_count, row.uncertain_percentage) == (2, 0.45, 0.55, 1, 25.0)


def test_regions():
    assert regions.empty_regions([], 1275, 1650) == []
    found = regions.empty_regions([(0, 0, 1275, 300), (0, 1000, 1275, 1650)], 1275, 1650)
    assert found == [(0, 300, 1300, 1000)]


def test_state(spark):
    cache = spark.createDataFrame([("a", "x", "m"), ("b", "y", "m")], "cache_key string, markdown string, method string")
    asked = spark.createDataFrame([("a",), ("c",)], "cache_key string")
    assert {(r.cache_key, r.cached) for r in state.probe(asked, cache).collect()} == {("a", True), ("c", False)}
    new = spark.createDataFrame([("a", "z", "m")], "cache_key string, markdown string, method string")
    assert {(r.cache_key, r.markdown) for r in state.save(cache, new).collect()} == {("a", "z"), ("b", "y")}
    runs = spark.createDataFrame([], "run_id long, ts timestamp, filename string, words long, elapsed double, method string")
    assert state.usage(runs).first().total_conversions == 0


def test_state_written_back(spark, tmp_path):
    runs = spark.createDataFrame([(k, f"f{k}", 100 * k, float(k)) for k in range(1, 13)], "run_id long, filename string, words long, elapsed double").withColumn("ts", F.timestamp_seconds("run_id")).withColumn("method", F.lit("x"))
    path = str(tmp_path / "history")
    state.write_back(state.history(runs.filter("run_id < 12")), path)
    state.write_back(state.save_history(spark.read.parquet(path), runs.filter("run_id = 12")), path)  # made from what it replaces
    assert sorted(r.run_id for r in spark.read.parquet(path).collect()) == list(range(3, 13))
    state.write_back(state.clear(spark.read.parquet(path)), path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == runs.select("run_id", "filename", "words", "elapsed", "ts", "method").columns
    stats = state.usage(runs.filter("run_id < 12"))
    assert state.update_usage(stats, runs.filter("run_id = 12")).first() == state.usage(runs).first()
    none = state.usage(runs.limit(0))
    assert state.update_usage(none, runs.limit(0)).first().avg_time == 0.0
    assert state.usage_display(state.usage(runs)).first().shown == "**Usage Statistics**\n\n**Total Conversions:** 12\n**Total Words:** 7,800\n**Avg Time:** 6.5s\n"


def test_adapters(spark, tmp_path):
    with pytest.raises(adapters.MissingLibrary):
        adapters.need("no_such_library_here")
    with pytest.raises(ValueError):
        adapters.check_request(100, "en")
    waits = []

    def fails():
        raise OSError("down")

    with pytest.raises(OSError):
        adapters.with_retries(fails, sleep=waits.append)
    assert waits == [3.0, 6.0, 12.0, 24.0]
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"no")
    files = adapters.binary_files(spark, str(tmp_path))
    assert files.count() == 1 and len(files.first().document_id) == 16
    rows = adapters.extract(files, lambda: lambda path, content: [{"path": path, "page_num": 1, "elem_idx": 0, "elem_type": "text", "content": content.decode()}])
    assert rows.first().content == "%PDF"
    (tmp_path / "s.json").write_text("{ invalid json }")
    assert adapters.json_state(spark, str(tmp_path / "s.json"), "total long").first().total is None


def test_pipeline(spark):
    rows = [(p, "text", t, 0.0, y, 10.0, 12.0, 0.9) for p in (1, 2, 3) for t, y in (("Annual Report", 10.0), (f"The body of page {p} goes on and is here.", 400.0), (f"Page {p}", 780.0))]
    markdown, report = document.process_documents(page(spark, rows))
    row, md = report.first(), markdown.first().md
    assert row.errors == 0 and row.language == "en" and row.passed
    assert md.startswith("---\ndocument:") and md.count("<!-- page:") == 3 and "<!-- role:header -->\nAnnual Report" in md
    kept = document.process_elements(page(spark, rows), noise_filter=False, caption_extraction=False)
    assert kept.count() == 9 and "noise_type" not in kept.columns


def test_markdown_is_a_table(spark):
    """Steps after render_markdown read its texts, which are put together once, and don't repeat its work."""
    rows = [(1, "text", t, 0.0, y, 10.0, 12.0, 0.9) for t, y in (("Some words of a page that are long enough", 100.0), ("and the end of it", 120.0))]
    markdown = document.render_markdown(document.process_elements(page(spark, rows)))
    assert "Generate" not in (plan := markdown._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan
    assert markdown.count() == 1
