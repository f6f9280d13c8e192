"""Captions linked to tables and figures, footnotes, and boxes that lie in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.patterns import FIGURE_CAPTION, FOOTNOTE, SUPERSCRIPT, TABLE_CAPTION
from folioscope.functions.text import strip
from folioscope.operators.noise import PAGE, matches_any


def parse_caption(content: Column) -> Column:
    """A struct of kind, number and text; null for what is no caption."""
    text = strip(content)
    part = lambda p, kind: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, p, 1).try_cast("int").alias("number"), strip(F.regexp_extract(text, p, 2)).alias("text"))
    return F.when(text.rlike(TABLE_CAPTION), part(TABLE_CAPTION, "table")).when(text.rlike(FIGURE_CAPTION), part(FIGURE_CAPTION, "figure"))


def is_caption(content: Column) -> Column:
    return matches_any(strip(content), [TABLE_CAPTION, FIGURE_CAPTION])


def _at() -> Column:
    return F.coalesce("y", "y0", F.lit(0.0))


def captions(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, elem_idx, y, kind, number, text) of every caption text."""
    rows = elements.filter("elem_type = 'text'").filter(is_caption(F.col("content"))).withColumn("__c", parse_caption(F.col("content")))
    return rows.select(*PAGE, "elem_idx", _at().alias("y"), "__c.kind", "__c.number", "__c.text")


def caption_links(elements: DataFrame, reach: float = 100) -> DataFrame:
    """(doc_key, page_num, caption_idx, target_idx, kind, number, text): each caption's nearest target of its kind on the page, less than `reach` away.

    The candidates of a page and kind share its keys, so the band is a residual of a hash join.
    """
    targets = elements.filter("elem_type in ('table', 'figure')").select(*PAGE, F.col("elem_type").alias("kind"), F.col("elem_idx").alias("target_idx"), _at().alias("target_y"))
    near = captions(elements).join(targets, [*PAGE, "kind"]).withColumn("d", F.abs(F.col("target_y") - F.col("y"))).filter(F.col("d") < reach)
    return near.groupBy(*PAGE, F.col("elem_idx").alias("caption_idx"), "kind", "number", "text").agg(F.min_by("target_idx", F.struct("d", "target_idx")).alias("target_idx"))


def extract_captions(elements: DataFrame, reach: float = 100, keep_unlinked: bool = False, base: DataFrame | None = None) -> DataFrame:
    """elements without caption texts, with caption and caption_number on the targets; the last of several captions wins.

    base: the same elements before earlier stages added columns; links are sought there, which spares a second run of those stages.
    """
    links = caption_links(base if base is not None else elements, reach)
    won = links.groupBy(*PAGE, F.col("target_idx").alias("elem_idx")).agg(F.max_by(F.struct("text", "number"), "caption_idx").alias("__w"))
    isnt = (F.col("elem_type") != "text") | ~is_caption(F.coalesce("content", F.lit("")))
    # By page, so that elements are dealt out once for this and what later goes by page.
    of_page = won.filter("elem_idx is not null").groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("elem_idx", "__w"))).alias("__m"))
    rows = elements.join(of_page, PAGE, "left").withColumn("__w", F.try_element_at("__m", F.col("elem_idx"))).drop("__m")
    if keep_unlinked:
        linked = links.select(*PAGE, F.col("caption_idx").alias("elem_idx"), F.lit(True).alias("__linked"))
        rows = rows.join(linked, [*PAGE, "elem_idx"], "left")
        isnt = isnt | F.col("__linked").isNull()
    return rows.filter(isnt).select(*elements.columns, F.col("__w.text").alias("caption"), F.col("__w.number").alias("caption_number"))


def caption_report(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, total_extracted, tables, figures) of linked captions."""
    return caption_links(elements).groupBy(*PAGE).agg(F.count("*").alias("total_extracted"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "figure").alias("figures"))


def parse_footnote(content: Column) -> Column:
    """A struct of id and text; null for what is no footnote. A superscript's id is its digit."""
    text = strip(content)
    out = F.when(text.rlike(rf"^[{SUPERSCRIPT}]\s*.+$"), F.struct(F.translate(F.substring(text, 1, 1), SUPERSCRIPT, "1234567890").alias("id"), F.regexp_extract(text, rf"^[{SUPERSCRIPT}]\s*(.+)$", 1).alias("text")))
    for p in reversed(FOOTNOTE):
        out = F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("id"), F.regexp_extract(text, p, 2).alias("text"))).otherwise(out)
    return out


def _is_footnote(bottom: float, height: float) -> Column:
    return (F.col("elem_type") == "text") & (_at() / height >= bottom) & matches_any(strip(F.coalesce("content", F.lit(""))), [*FOOTNOTE, rf"^[{SUPERSCRIPT}]\s*.+$"])


def mark_footnotes(elements: DataFrame, bottom: float = 0.8, height: float = 800) -> DataFrame:
    """elements with footnote_role and footnote_id for footnote texts at the foot of a page."""
    marked = elements.withColumn("footnote_role", F.when(_is_footnote(bottom, height), "footnote"))
    digits = F.regexp_extract(strip(F.col("content")), r"^\[?(\d+)\]?", 1)
    return marked.withColumn("footnote_id", F.when(F.col("footnote_role").isNotNull(), F.nullif(digits, F.lit(""))))


def footnotes(elements: DataFrame, bottom: float = 0.8, height: float = 800) -> DataFrame:
    rows = elements.filter(_is_footnote(bottom, height)).withColumn("__f", parse_footnote(F.col("content")))
    return rows.select(*PAGE, "elem_idx", F.col("__f.id").alias("footnote_id"), F.col("__f.text").alias("footnote_text"))


def footnote_refs(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, elem_idx, ref, has_content): bracketed references within texts, and whether the page has that footnote."""
    rows = elements.filter("elem_type = 'text'").select(*PAGE, "elem_idx", F.explode(F.regexp_extract_all("content", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("ref"))
    known = footnotes(elements).select(*PAGE, F.col("footnote_id").alias("ref")).distinct().withColumn("has_content", F.lit(True))
    return rows.join(known, [*PAGE, "ref"], "left").select(*PAGE, "elem_idx", "ref", F.coalesce("has_content", F.lit(False)).alias("has_content"))


def captions_and_footnotes(elements: DataFrame) -> DataFrame:
    return mark_footnotes(extract_captions(elements))


def outside_tables(elements: DataFrame) -> DataFrame:
    """Text elements whose centre lies in no table box of their page."""
    tables = elements.filter("elem_type = 'table'").select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    text = elements.filter("elem_type = 'text'")
    cx, cy = (text["x0"] + text["x1"]) / 2, (text["y0"] + text["y1"]) / 2
    inside = (tables["t_x0"] <= cx) & (cx <= tables["t_x1"]) & (tables["t_y0"] <= cy) & (cy <= tables["t_y1"])
    return text.join(tables, (text["doc_key"] == tables["doc_key"]) & (text["page_num"] == tables["page_num"]) & inside, "left_anti")


def blocks_off_tables(elements: DataFrame, share: float = 0.6, grow: float = 0.0) -> DataFrame:
    """Text elements of whose area at most `share` is covered by any one table box of the page; `grow` widens the tables."""
    tables = elements.filter("elem_type = 'table'").select(F.col("doc_key").alias("t_doc"), F.col("page_num").alias("t_page"), (F.col("x0") - grow).alias("t_x0"), (F.col("y0") - grow).alias("t_y0"), (F.col("x1") + grow).alias("t_x1"), (F.col("y1") + grow).alias("t_y1"))
    text = elements.filter("elem_type = 'text'")
    wide = F.greatest(F.lit(0.0), F.least("x1", "t_x1") - F.greatest("x0", "t_x0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "t_y1") - F.greatest("y0", "t_y0"))
    covered = wide * high > share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return text.join(tables, (F.col("doc_key") == F.col("t_doc")) & (F.col("page_num") == F.col("t_page")) & covered, "left_anti")


def polygon_box(polygon: Column) -> Column:
    """The box around an array of points with x and y."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
