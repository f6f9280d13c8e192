"""Roles of texts by content, and elements rendered as annotated Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.patterns import CAPTION_START, CHAPTER, EQUATION, FOOTNOTE_START, HEADING, ORDERED, UNORDERED
from folioscope.functions.text import merge_hyphens, strip
from folioscope.operators.noise import PAGE, matches_any

HEIGHT = 800.0


def page_context(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, avg_font_size, avg_text_length) over a page's texts, 12 and 50 where there is none."""
    text = F.col("elem_type") == "text"
    size = F.avg(F.when(text & (F.col("font_size") != 0), F.col("font_size")))
    return elements.groupBy(*PAGE).agg(F.coalesce(size, F.lit(12.0)).alias("avg_font_size"), F.coalesce(F.avg(F.when(text, F.length(F.coalesce("content", F.lit(""))))), F.lit(50.0)).alias("avg_text_length"))


def _role(role: str, name: str | None = None, value: Column | str | None = None, level: Column | None = None) -> Column:
    attribute = F.lit("") if name is None else F.concat(F.lit(f" {name}:"), value if isinstance(value, Column) else F.lit(value))
    return F.struct(F.lit(role).alias("role"), attribute.alias("attrs"), (level if level is not None else F.lit(None).cast("int")).alias("level"))


def classify(text: Column, average: Column, height: float = HEIGHT) -> Column:
    """A struct of role, attributes as written in a marker, and heading level, for a stripped text."""
    size, y0 = F.col("font_size"), F.col("y0")
    by_size = F.when(size > average * 1.8, 1).when(size > average * 1.5, 2).otherwise(3)
    by_pattern = F.when(text.rlike(CHAPTER), 1).when(text.rlike(r"^\d+\.\d+"), 3).otherwise(2)
    # A numbered section is level 3 only where an earlier pattern doesn't decide.
    titled = (F.length(text) < 60) & text.rlike(r"^\p{Lu}") & ~text.rlike(r"[.!?,;:]$") & (y0 / height < 0.15)
    kind = F.when(F.lower(text).contains("table") | F.lower(text).contains("tbl"), "table").otherwise("figure")
    digits = F.regexp_extract(F.substring(text, 1, 10), r"\d+", 0)
    note = F.when(digits == "", "1").otherwise(digits)
    low = (y0 / height > 0.85) & (F.length(text) < 200) & text.rlike(r"^\d")
    display = F.when(F.length(text) > 20, "block").otherwise("inline")
    return (
        F.when((size != 0) & (size > average * 1.3), _role("heading", "level", by_size.cast("string"), by_size))
        .when(matches_any(text, HEADING), _role("heading", "level", by_pattern.cast("string"), by_pattern))
        .when(titled, _role("heading", "level", "2", F.lit(2)))
        .when(text.rlike(UNORDERED), _role("list_item", "type", "unordered"))
        .when(text.rlike(ORDERED), _role("list_item", "type", "ordered"))
        .when(text.rlike(CAPTION_START), _role("caption", "for", kind))
        .when(matches_any(text, FOOTNOTE_START), _role("footnote", "id", note))
        .when(matches_any(text, EQUATION), _role("equation", "display", display))
        .when(low, _role("footnote", "id", F.regexp_extract(text, r"^(\d+)", 1)))
        .otherwise(_role("paragraph"))
    )


def text_roles(elements: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Text elements with role, attrs and level; a noise_type takes the role's place."""
    page = Window.partitionBy(*PAGE)
    average = F.coalesce(F.avg(F.when((F.col("elem_type") == "text") & (F.col("font_size") != 0), F.col("font_size"))).over(page), F.lit(12.0))
    rows = elements.withColumn("__avg", average).withColumn("__t", strip(F.coalesce("content", F.lit(""))))
    verdict = classify(F.col("__t"), F.col("__avg"), height)
    if "noise_type" in elements.columns:
        verdict = F.when(F.col("noise_type").isNotNull(), F.struct(F.col("noise_type").alias("role"), F.lit("").alias("attrs"), F.lit(None).cast("int").alias("level"))).otherwise(verdict)
    return rows.withColumn("__v", F.when(F.col("elem_type") == "text", verdict)).select(*elements.columns, F.col("__v.role").alias("role"), F.col("__v.attrs").alias("attrs"), F.col("__v.level").alias("level"))


def annotated(rows: DataFrame) -> DataFrame:
    """Elements from text_roles() with `md`: markers and body; null where a text is empty."""
    have = set(rows.columns)
    order = F.when(F.col("reading_order").isNotNull(), F.concat(F.lit("<!-- reading-order:"), F.col("reading_order").cast("string"), F.lit(" -->\n"))).otherwise("") if "reading_order" in have else F.lit("")
    text, sure = strip(F.coalesce("content", F.lit(""))), F.coalesce(F.col("confidence"), F.lit(1.0))
    body = (
        F.when(F.col("role") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(2))), F.lit(" "), text))
        .when((F.col("role") == "equation") & F.endswith("attrs", F.lit("block")), F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(F.col("role") == "equation", F.concat(F.lit("$"), text, F.lit("$")))
        .when(sure < 0.5, F.concat(F.lit("[low-confidence: "), text, F.lit("]")))
        .when(sure < 0.7, F.concat(F.lit("[uncertain: "), text, F.lit("]")))
        .otherwise(text)
    )
    low = F.when(sure < 0.7, F.concat(F.lit("<!-- confidence:"), F.format_string("%.2f", sure), F.lit(" -->\n"))).otherwise("")
    plain = F.concat(order, F.lit("<!-- role:"), F.col("role"), F.col("attrs"), F.lit(" -->\n"), low, body, F.lit("\n"))
    caption = F.coalesce("caption", F.lit("")) if "caption" in have else F.lit("")
    marked = F.when(caption != "", F.concat(F.lit(' caption:"'), F.replace(caption, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise("")
    table = F.concat(order, F.lit("<!-- role:table"), marked, F.lit(" -->\n"), F.when(caption != "", F.concat(F.lit("\n**"), caption, F.lit("**\n\n"))).otherwise(""), F.coalesce("content", F.lit("")), F.lit("\n"))
    figure = F.concat(order, F.lit("<!-- role:figure"), marked, F.lit(" -->\n![Figure](image)\n"), F.when(caption != "", F.concat(F.lit("\n*"), caption, F.lit("*\n"))).otherwise(""))
    return rows.withColumn("md", F.when(F.col("elem_type") == "table", table).when(F.col("elem_type") == "figure", figure).when(text != "", plain))


def _place(rows: DataFrame, by_y: bool) -> Column:
    order = F.col("reading_order") if "reading_order" in rows.columns and not by_y else F.lit(None).cast("long")
    return F.struct(F.coalesce(order, F.lit(0)).alias("r"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("elem_idx").alias("i"))


def render_order(elements: DataFrame, by_y: bool = False) -> DataFrame:
    """elements with render_pos: by reading order (0 where there is none, so tables and figures come first), then y."""
    place = _place(elements, by_y)
    return elements.withColumn("__p", place).withColumn("render_pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("__p"))).drop("__p")


def pages_markdown(rows: DataFrame, by_y: bool = False, more: tuple[Column, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """(doc_key, page_num, md) of annotated elements, and more aggregates of these names. A page is one group; its size is that of a page."""
    each = F.struct(_place(rows, by_y).alias("p"), F.col("md").alias("md"))
    grouped = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.when(F.col("md").isNotNull(), each))).alias("xs"), *[m.alias(n) for m, n in zip(more, names, strict=True)])
    body = F.array_join(F.transform("xs", lambda x: F.concat(x["md"], F.lit("\n"))), "")
    return grouped.select(*PAGE, F.concat(F.lit("\n<!-- page:"), F.col("page_num").cast("string"), F.lit(" -->\n\n"), body).alias("md"), *names)


def documents_markdown(pages: DataFrame) -> DataFrame:
    """(doc_key, md): page texts in order; one string per document is what is asked for, so a document must fit a row."""
    grouped = pages.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("page_num", "md"))).alias("ps"))
    return grouped.select("doc_key", F.array_join(F.transform("ps", lambda p: p["md"]), "").alias("md"))


def annotate_document(elements: DataFrame) -> DataFrame:
    return documents_markdown(pages_markdown(annotated(text_roles(elements))))


def fallback_pages(elements: DataFrame) -> DataFrame:
    """Pages with texts and tables as they stand, without roles."""
    rows = elements.withColumn("md", F.when(F.col("elem_type").isin("text", "table"), F.concat(F.coalesce("content", F.lit("")), F.lit("\n"))))
    each = F.struct("elem_idx", "md")
    grouped = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.when(F.col("md").isNotNull(), each))).alias("xs"))
    return grouped.select(*PAGE, F.concat(F.lit("\n<!-- page:"), F.col("page_num").cast("string"), F.lit(" -->\n\n"), F.array_join(F.transform("xs", lambda x: F.concat(x["md"], F.lit("\n"))), "")).alias("md"))


def plain_pages(laid_out: DataFrame) -> DataFrame:
    """Pages by the older rules: roles from the layout, paragraphs unmarked, hyphens merged within runs of text.

    laid_out: elements with semantic_role, role_confidence, uncertain; a run is what lies between tables and figures.
    """
    w = Window.partitionBy(*PAGE).orderBy("__p")
    solid = F.col("elem_type").isin("table", "figure")
    rows = laid_out.withColumn("__p", _place(laid_out, False)).withColumn("run", F.sum(F.when(solid, 1).otherwise(0)).over(w) * 2 - F.when(solid, 1).otherwise(0))
    role, sure = F.col("semantic_role"), F.coalesce("confidence", F.lit(1.0))
    weak = F.coalesce("role_confidence", F.lit(1.0))
    mark = F.when(role.isNull() | (role == "paragraph"), "").when((role == "heading") & (weak < 0.6), F.concat(F.lit("<!-- role:heading confidence:"), F.format_string("%.2f", weak), F.lit(" -->\n"))).otherwise(F.concat(F.lit("<!-- role:"), role, F.lit(" -->\n")))
    low = F.when(sure < 0.7, F.concat(F.lit("<!-- confidence:"), F.format_string("%.2f", sure), F.lit(" -->\n"))).otherwise("")
    body = F.when(F.coalesce("uncertain", F.lit(False)), F.concat(F.lit("[uncertain: "), F.col("content"), F.lit("]\n"))).otherwise(F.concat(F.col("content"), F.lit("\n")))
    piece = (
        F.when(F.col("elem_type") == "table", F.concat(F.lit("<!-- role:table -->\n\n"), F.col("content"), F.lit("\n\n")))
        .when(F.col("elem_type") == "figure", F.concat(F.lit("<!-- role:figure -->\n"), F.col("content"), F.lit("\n\n")))
        .otherwise(F.concat(mark, low, body))
    )
    runs = rows.groupBy(*PAGE, "run").agg(F.sort_array(F.collect_list(F.struct("__p", piece.alias("md")))).alias("xs"), F.max(solid).alias("solid"))
    joined = F.array_join(F.transform("xs", lambda x: x["md"]), "")
    text = F.when(F.col("solid"), joined).otherwise(F.concat(merge_hyphens(joined), F.lit("\n")))
    pages = runs.select(*PAGE, "run", text.alias("md")).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("run", "md"))).alias("xs"))
    return pages.select(*PAGE, F.concat(F.lit("\n\n<!-- page:"), F.col("page_num").cast("string"), F.lit(" -->\n\n"), F.array_join(F.transform("xs", lambda x: x["md"]), "")).alias("md"))


def structure(elements: DataFrame) -> DataFrame:
    """One row per document: number of headings and sections, what it has, and whether its first pages look like a table of contents."""
    rows = text_roles(elements)
    is_head = F.col("role") == "heading"
    return rows.groupBy("doc_key").agg(
        F.count_if(is_head).alias("heading_count"),
        F.count_if(is_head & (F.col("level") <= 2)).alias("section_count"),
        F.coalesce(F.bool_or(F.col("role") == "footnote"), F.lit(False)).alias("has_footnotes"),
        F.coalesce(F.bool_or(F.col("role") == "equation"), F.lit(False)).alias("has_equations"),
        F.bool_or(F.col("elem_type") == "table").alias("has_tables"),
        F.bool_or(F.col("elem_type") == "figure").alias("has_figures"),
        (F.count_if(is_head & (F.col("page_num") <= 2)) > 5).alias("has_toc"),
    )


def heading_list(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, elem_idx, text, level) of every heading, 50 characters each."""
    return text_roles(elements).filter("role = 'heading'").select(*PAGE, "elem_idx", F.substring("content", 1, 50).alias("text"), "level")


def body_size(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, body_size): the most frequent font size of a page, rounded to 0.1; the one seen first on a tie; 11 without any."""
    sizes = elements.filter("elem_type = 'text' and font_size is not null").groupBy(*PAGE, F.round("font_size", 1).alias("s")).agg(F.count("*").alias("n"), F.min("elem_idx").alias("f"))
    best = sizes.groupBy(*PAGE).agg(F.max_by("s", F.struct("n", -F.col("f"))).alias("s"))
    return elements.select(*PAGE).distinct().join(best, PAGE, "left").select(*PAGE, F.coalesce("s", F.lit(11.0)).alias("body_size"))


def fast_blocks(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, elem_idx, md): blocks off tables with marks by font size; bullets as hyphens."""
    from folioscope.operators.links import blocks_off_tables

    text = blocks_off_tables(elements).join(body_size(elements), PAGE)
    ratio_up = (F.col("font_size") > F.col("body_size") * 1.05) & (F.col("font_size") < F.col("body_size") * 2.5)
    head = F.when(ratio_up & (F.col("font_size") > F.col("body_size") * 1.5), "# ").when(ratio_up, "## ").otherwise("")
    plain = strip(F.col("content"))
    bullet = plain.rlike(r"^[•*-]") & ~ratio_up
    body = F.when(bullet, F.concat(F.lit("- "), F.regexp_replace(plain, r"^[•* -]+", ""))).otherwise(F.col("content"))
    out = text.select(*PAGE, "elem_idx", "y0", "x0", strip(F.concat(head, body)).alias("md")).filter("md <> ''")
    tables = elements.filter("elem_type = 'table'").select(*PAGE, "elem_idx", "y0", "x0", F.col("content").alias("md"))
    return out.unionByName(tables)


def fast_pages(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, md): fast blocks by place, with a page break."""
    each = F.struct("y0", "x0", "elem_idx", "md")
    pages = fast_blocks(elements).groupBy(*PAGE).agg(F.sort_array(F.collect_list(each)).alias("xs"))
    text = F.concat(F.array_join(F.transform("xs", lambda x: F.concat(x["md"], F.lit("\n\n"))), ""), F.lit("\n--- Page Break ---\n\n"))
    return pages.select(*PAGE, merge_hyphens(text).alias("md"))
