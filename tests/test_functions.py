"""Column functions on literal cases."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.functions import text as T
from folioscope.operators import enforce, export


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "t string").select(column_of(F.col("t")).alias("out")).first().out


def many(spark, column_of, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, t string").select("k", column_of(F.col("t")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.k)]


def test_hyphens(spark):
    assert one(spark, T.merge_hyphens, "a bro- \n ken b") == "a broken b"
    assert one(spark, T.merge_hyphens, "Ab1-\nCd") == "Ab1-\nCd"
    assert one(spark, lambda c: T.merge_hyphens(c, strict=False), "Ab1-\nCd") == "Ab1Cd"


@pytest.mark.parametrize(
    "given_,wanted",
    [
        ("− a – b — c ―", "- a - b - c -"),
        ("    - item", "- item"),
        ("* a\n* b", "- a\n- b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\n# H", "a\n\n# H"),
        ("x <!-- role:artifact -->\n<!-- /role -->", "x"),
    ],
)
def test_normalize(spark, given_, wanted):
    assert one(spark, T.normalize_markdown, given_) == wanted


def test_names(spark):
    cases = ["Gemini 2.0 Flash Lite ($0.08/1K pages)", "file<>:name|with?invalid*chars", "x" * 300]
    out = many(spark, T.safe_file_name, cases)
    assert out == ["Gemini_2.0_Flash_Lite_USD0.08_1K_pages", "file_name_with_invalid_chars", "x" * 200]


def test_dates(spark):
    cases = ["D:20240115120000", "D:20240115", "20231231235959", "", None, "invalid", "D:2019", "D:20"]
    wanted = ["2024-01-15T12:00:00", "2024-01-15T00:00:00", "2023-12-31T23:59:59", "", "", "", "2019-01-01T00:00:00", ""]
    assert many(spark, S.pdf_date, cases) == wanted


def test_plain_text(spark):
    assert one(spark, T.markdown_to_text, "## A **b** *c* [d](e) `f`") == "A b c d `f`"
    assert one(spark, lambda c: T.markdown_to_text(c, code=True), "`f`") == "f"


def test_front_matter(spark):
    assert one(spark, T.front_matter, "---\na: 1\n---\nx") == "\na: 1\n"
    assert one(spark, T.front_matter, "---\na: 1") is None


def test_sequences(spark):
    pages = lambda c: T.in_sequence(T.numbers_of(c, "page"))
    assert many(spark, pages, ["<!-- page:1 --> <!-- page:2 -->", "<!-- page:1 --><!-- page:3 --><!-- page:2 -->", "none"]) == [True, False, True]


def test_tables(spark):
    rows = spark.createDataFrame([(["| a | bbbb |", "|:--|---|", "| longer | x |", "| y |"],), (["| one |"],)], "r array<string>")
    out = [r.o for r in rows.select(enforce.format_rows(F.col("r")).alias("o")).collect()]
    assert out[0] == ["| a      | bbbb |", "| ------ | ---- |", "| longer | x    |", "| y      |      |"]
    assert out[1] == ["| one |"]


def test_defragment(spark):
    df = spark.createDataFrame([(1, "List item:\n- one\n- two"), (2, "a\nb.\nc\n\nd")], "k int, md string")
    out = {r.k: r.md for r in export.defragment(df, "k").collect()}
    assert out == {1: "List item:\n- one - two", 2: "a b.\nc\n\nd"}


def test_shift_headings(spark):
    assert one(spark, T.shift_headings, "## A\ntext\n### B") == "# A\ntext\n## B"
    assert one(spark, T.shift_headings, "# A\n### B") == "# A\n### B"


def test_page_markers(spark):
    cases = ["## Page 2\nx", "x", "---\na\n---\nx", "<!-- page: 4 -->"]
    wanted = ["<!-- page:2 -->\nx", "<!-- page:1 -->\n\nx", "---\na\n---\n\n<!-- page:1 -->\nx", "<!-- page: 4 -->"]
    assert many(spark, enforce.ensure_page_markers, cases) == wanted


def test_roles_of_lines(spark):
    text = "## A\n<!-- role:heading level:1 -->\n# B\n| a |\n| b |\n---"
    wanted = "<!-- role:heading level:2 -->\n## A\n<!-- role:heading level:1 -->\n# B\n<!-- role:table -->\n| a |\n<!-- role:table -->\n| b |\n---"
    assert one(spark, enforce.annotate_lines, text) == wanted


def test_costs(spark):
    row = spark.range(1).select(S.cost_by_pages(F.lit("Mistral Pixtral Large ($2/1K pages)"), F.lit(500)).alias("a"), S.cost_by_pages(F.lit("?"), F.lit(500)).alias("b"), S.cost_by_tokens(F.lit("Mistral Pixtral Large ($2/1K pages)"), F.lit(1)).alias("c")).first()
    assert row.a == "**Estimated Cost:** $1.00" and row.b == "**Estimated Cost:** FREE" and row.c == "**Estimated Cost:** ~$0.0000 (1 page)"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1-_ \n*#|.", max_size=40), min_size=1, max_size=30))
def test_against_plain_versions(spark, texts):
    assert many(spark, T.merge_hyphens, texts) == [re.sub(r"([a-zA-Z]+)-\s*\n\s*([a-z]+)", r"\1\2", t) for t in texts]
    assert many(spark, T.strip, texts) == [t.strip() for t in texts]
    assert many(spark, lambda c: F.size(T.words(c)), texts) == [len(t.split()) for t in texts]
    assert many(spark, T.mask_numbers, texts) == [re.sub(r"\b\d+\b", "[NUM]", t.strip()) for t in texts]
    assert many(spark, T.clean_ends, texts) == ["\n".join(x.rstrip() for x in re.sub(r"\n{4,}", "\n\n\n", t).split("\n")).rstrip("\n") + "\n" for t in texts]


def test_fixed_places_are_those_of_printf(spark):
    values = [0.005, 0.015, 0.025, 0.045, 0.125, 0.285, 0.375, 0.995, 1.005, 2.5, 0.0, -0.015, -0.125, 1234567.125, 1e10 + 0.25, 2.675, 0.00005, 0.00015, 3e15]
    values += [k * 0.005 for k in range(400)] + [k / 1000 * 0.05 for k in range(700)] + [k / 1000 * 0.15 for k in range(700)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.fixed(F.col("x"), 2).alias("two"), S.fixed(F.col("x"), 4).alias("four")).collect()
    assert [(r.two, r.four) for r in rows] == [(f"{r.x:.2f}", f"{r.x:.4f}") for r in rows]
    price = spark.range(1).select(S.cost_by_pages(F.lit("Qwen 2.5-VL 72B ($0.15/1K pages)"), F.lit(100)).alias("a")).first().a
    assert price == f"**Estimated Cost:** ${100 / 1000 * 0.15:.2f}" == "**Estimated Cost:** $0.01"
