"""Noise on pages: page numbers, running heads and feet, watermarks, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.patterns import ARTIFACT, CONSONANTS, PAGE_NUMBER, RUNNING, WATERMARK
from folioscope.functions.text import fold_case, mask_numbers, strip

PAGE = ["doc_key", "page_num"]


def matches_any(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Does any pattern match? One expression, so that it is compiled once and the generated code stays small."""
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def is_page_number(content: Column) -> Column:
    return matches_any(strip(content), PAGE_NUMBER, True)


def is_watermark(content: Column) -> Column:
    return matches_any(strip(content), WATERMARK, True)


def is_garbled(content: Column) -> Column:
    """Mostly signs, five consonants in a row, or one character five times."""
    special = F.length(F.regexp_replace(content, r"[\p{L}\p{N}\s]", ""))
    return (F.length(content) >= 3) & ((special / F.length(content) > 0.5) | content.rlike(CONSONANTS) | content.rlike(r"(.)\1{4,}"))


def is_artifact(content: Column, confidence: Column) -> Column:
    return _artifact(strip(content), confidence)


def _artifact(text: Column, confidence: Column) -> Column:
    return matches_any(text, ARTIFACT) | ((F.coalesce(confidence, F.lit(1.0)) < 0.3) & (F.length(text) < 10)) | is_garbled(text)


def page_counts(elements: DataFrame) -> DataFrame:
    """(doc_key, n_pages)."""
    return elements.groupBy("doc_key").agg(F.countDistinct("page_num").alias("n_pages"))


def repeating_content(elements: DataFrame, threshold: float = 0.5, edge: int = 3) -> DataFrame:
    """(doc_key, norm_text, n_top, n_bottom, is_header, is_footer): texts at page edges that recur on enough pages.

    Candidates are the first and last `edge` text elements of a page by y within its upper and lower third.
    """
    text = elements.filter("elem_type = 'text'")
    page = Window.partitionBy(*PAGE)
    ranked = text.select(
        *PAGE,
        F.col("y"),
        mask_numbers(F.col("content")).alias("norm_text"),
        F.row_number().over(page.orderBy("y", "elem_idx")).alias("first"),
        F.row_number().over(page.orderBy(F.desc("y"), F.desc("elem_idx"))).alias("last"),
        F.greatest(F.max("y").over(page), F.lit(100.0)).alias("height"),
    )
    near = ranked.filter((F.col("first") <= edge) | (F.col("last") <= edge)).filter((F.length("norm_text") > 0) & (F.length("norm_text") < 100))
    top = (F.col("first") <= edge) & (F.col("y") < F.col("height") * 0.33)
    bottom = (F.col("last") <= edge) & (F.col("y") > F.col("height") * 0.67)
    counted = near.groupBy("doc_key", "norm_text").agg(F.count_if(top).alias("n_top"), F.count_if(bottom).alias("n_bottom"))
    # One row per document; its size follows the documents, so the join is left to the planner.
    flagged = counted.join(page_counts(elements), "doc_key")
    need = F.col("n_pages") * threshold
    out = flagged.withColumn("is_header", (F.col("n_top") > 0) & (F.col("n_top") >= need)).withColumn("is_footer", (F.col("n_bottom") > 0) & (F.col("n_bottom") >= need))
    return out.filter("is_header or is_footer").select("doc_key", "norm_text", "n_top", "n_bottom", "is_header", "is_footer")


def tag_noise(elements: DataFrame, threshold: float = 0.5, min_pages: int = 3, repeaters: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """elements with noise_type: the first of page_number, header, footer, watermark, artifact that holds for a text. repeaters, counts: the elements' repeating_content() and page_counts(), where they are at hand."""
    repeaters = repeaters if repeaters is not None else repeating_content(elements, threshold)
    counts = counts if counts is not None else page_counts(elements)
    keyed = elements.withColumn("__t", F.when(F.col("elem_type") == "text", strip(F.col("content")))).withColumn("norm_text", mask_numbers(F.col("__t")))
    joined = keyed.join(repeaters.select("doc_key", "norm_text", "is_header", "is_footer"), ["doc_key", "norm_text"], "left").join(counts, "doc_key")
    many = F.col("n_pages") >= min_pages
    noise = (
        F.when(matches_any(F.col("__t"), PAGE_NUMBER, True), "page_number")
        .when(many & F.coalesce("is_header", F.lit(False)), "header")
        .when(many & F.coalesce("is_footer", F.lit(False)), "footer")
        .when(matches_any(F.col("__t"), WATERMARK, True), "watermark")
        .when(_artifact(F.col("__t"), F.col("confidence")), "artifact")
    )
    return joined.withColumn("noise_type", F.when(F.col("elem_type") == "text", noise)).select(*elements.columns, "noise_type")


def remove_noise(elements: DataFrame) -> DataFrame:
    """The elements that tag_noise() leaves untagged."""
    return tag_noise(elements).filter("noise_type is null").drop("noise_type")


def noise_report(elements: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """One row per document: counts by class. headers_detected counts distinct repeating texts and each tagged row; the distinct counts stand beside it."""
    tagged = tagged if tagged is not None else tag_noise(elements)
    of = lambda kind: F.count_if(F.col("noise_type") == kind)
    rows = tagged.groupBy("doc_key").agg(of("header").alias("h"), of("footer").alias("f"), of("watermark").alias("w"), of("page_number").alias("p"), of("artifact").alias("a"), F.countDistinct("page_num").alias("n"))
    distinct = repeating_content(elements).groupBy("doc_key").agg(F.count_if("is_header").alias("dh"), F.count_if("is_footer").alias("df"))
    joined = rows.join(distinct, "doc_key", "left")
    many = F.col("n") >= 3
    zero = lambda c: F.when(many, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return joined.select(
        "doc_key",
        zero(F.col("h") + F.coalesce("dh", F.lit(0))).alias("headers_detected"),
        zero(F.col("f") + F.coalesce("df", F.lit(0))).alias("footers_detected"),
        zero(F.col("dh")).alias("distinct_headers"),
        zero(F.col("df")).alias("distinct_footers"),
        zero(F.col("w")).alias("watermarks_removed"),
        zero(F.col("p")).alias("page_numbers_removed"),
        zero(F.col("a")).alias("artifacts_removed"),
    )


def running_texts(elements: DataFrame, threshold: float = 0.6, min_pages: int = 3) -> DataFrame:
    """(doc_key, norm_text, role): texts that recur as running head or foot, by pattern or place, on enough pages."""
    page = Window.partitionBy(*PAGE)
    tall = elements.withColumn("height", F.max(F.coalesce("y1", "y")).over(page)).filter("elem_type = 'text'")
    text = strip(F.col("content"))
    top = F.coalesce("y0", "y") < F.col("height") * 0.1
    bottom = ~top & (F.coalesce("y0", "y") > F.col("height") * 0.9)
    rows = tall.filter(F.length(text) >= 3).select("doc_key", fold_case(F.col("content")).alias("norm_text"), top.alias("t"), bottom.alias("b"), matches_any(text, RUNNING).alias("hit"))
    found = rows.filter("hit or t or b").groupBy("doc_key", "norm_text").agg(F.count("*").alias("n"), F.count_if("t").alias("nt"), F.count_if("b").alias("nb"))
    joined = found.join(page_counts(elements), "doc_key").filter((F.col("n_pages") >= min_pages) & (F.col("n") / F.col("n_pages") >= threshold))
    return joined.select("doc_key", "norm_text", F.when(F.col("nt") > F.col("nb"), "header").otherwise("footer").alias("role"))


def tag_headers_footers(elements: DataFrame, threshold: float = 0.6) -> DataFrame:
    """elements with semantic_role header or footer where a text recurs, else null."""
    keyed = elements.withColumn("norm_text", F.when(F.col("elem_type") == "text", fold_case(F.col("content"))))
    return keyed.join(running_texts(elements, threshold), ["doc_key", "norm_text"], "left").select(*elements.columns, F.col("role").alias("semantic_role"))


def remove_headers_footers(elements: DataFrame, threshold: float = 0.6) -> DataFrame:
    return tag_headers_footers(elements, threshold).filter("semantic_role is null").drop("semantic_role")
