"""Page layout: columns, reading order and roles from the places of text boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.patterns import BULLETS, CAPTION_WORDS, LEGACY_BULLETS
from folioscope.functions.text import strip, words
from folioscope.operators.confidence import split_by_confidence
from folioscope.operators.noise import PAGE


def detect_columns(elements: DataFrame, gap: float = 50) -> DataFrame:
    """(doc_key, page_num, column_id, x_min, x_max): left edges of a page, parted where they lie more than `gap` apart."""
    edges = elements.filter("x0 is not null").select(*PAGE, "x0").distinct()
    w = Window.partitionBy(*PAGE).orderBy("x0")
    starts = edges.withColumn("new", F.coalesce(F.col("x0") - F.lag("x0").over(w) > gap, F.lit(False)).cast("long"))
    islands = starts.withColumn("column_id", F.sum("new").over(w))
    return islands.groupBy(*PAGE, "column_id").agg(F.min("x0").alias("x_min"), F.max("x0").alias("x_max"))


def assign_columns(elements: DataFrame, columns: DataFrame | None = None, gap: float = 50) -> DataFrame:
    """elements with column_id: the first column that holds the box's centre, else the one with the nearest middle.

    A page's columns are gathered into one short array, so the lookup needs no range join.
    """
    columns = columns if columns is not None else detect_columns(elements, gap)
    lists = columns.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("column_id", "x_min", "x_max"))).alias("cols"))
    centre = (F.col("x0") + F.col("x1")) / 2

    def far(c: Column) -> Column:
        inside = (c["x_min"] <= centre) & (centre <= c["x_max"])
        return F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(F.abs(centre - (c["x_min"] + c["x_max"]) / 2)).alias("d"), c["column_id"].alias("id"))

    best = F.array_min(F.transform("cols", far))["id"]
    return elements.join(lists, PAGE, "left").withColumn("column_id", F.when(F.col("x0").isNull(), F.lit(0).cast("long")).otherwise(best)).drop("cols")


def reading_order(elements: DataFrame) -> DataFrame:
    """elements with reading_order: columns from left to right, each from top to bottom, counted from 1 on each page."""
    w = Window.partitionBy(*PAGE).orderBy("column_id", "y0", "elem_idx")
    return elements.withColumn("reading_order", F.row_number().over(w).cast("long"))


def gaps(elements: DataFrame) -> DataFrame:
    """elements with the vertical gap before and after, in reading order."""
    w = Window.partitionBy(*PAGE).orderBy("reading_order")
    return elements.withColumn("gap_before", F.col("y0") - F.lag("y1").over(w)).withColumn("gap_after", F.lead("y0").over(w) - F.col("y1"))


def cap_score(text: Column) -> Column:
    """How much the case of a text looks like a heading."""
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    own = words(text)
    big = F.size(F.filter(own, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")))
    n = F.size(own)
    return (
        F.when(upper & (F.length(text) > 3), 0.9)
        .when(n > 1, F.when(big / n > 0.7, 0.6).otherwise(0.0))
        .when((n == 1) & F.substring(own[0], 1, 1).rlike(r"^\p{Lu}"), 0.2)
        .otherwise(0.0)
    )


def _page_stats(elements: DataFrame) -> DataFrame:
    """The page's mean height, line spacing and edges as columns, in one window over the page."""
    page = Window.partitionBy(*PAGE)
    n = F.count("y0").over(page)
    return (
        elements.withColumn("avg_h", F.avg(F.col("y1") - F.col("y0")).over(page))
        .withColumn("spacing", F.when(n > 1, (F.max("y0").over(page) - F.min("y0").over(page)) / (n - 1)).otherwise(20.0))
        .withColumn("page_w", F.max("x1").over(page))
        .withColumn("page_l", F.min("x0").over(page))
        .withColumn("page_h", F.max("y1").over(page))
    )


def _caption(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for word in CAPTION_WORDS:
        out = out | F.startswith(low, F.lit(word))
    return out


def heading_score(text: Column) -> Column:
    """The weighted signals; needs the columns of gaps() and of the page statistics."""
    h = F.col("y1") - F.col("y0")
    font = F.when(h > F.col("avg_h") * 1.4, 1.0).when(h > F.col("avg_h") * 1.2, 0.7).when(h > F.col("avg_h") * 1.1, 0.4).otherwise(0.0)
    before = F.when(F.col("gap_before") > F.col("spacing") * 2, 0.5).when(F.col("gap_before") > F.col("spacing") * 1.5, 0.3).otherwise(0.0)
    after = F.when(F.col("gap_after") > F.col("spacing") * 1.5, 0.3).otherwise(0.0)
    n = F.length(text)
    short = F.when(n < 50, 0.8).when(n < 100, 0.5).when(n < 200, 0.2).otherwise(0.0)
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("page_l") + F.col("page_w")) / 2) < F.col("page_w") * 0.1
    indent = F.when(centred, 0.7).when(F.col("x0") <= F.col("page_l") + 10, 0.3).otherwise(0.0)
    return font * 0.35 + F.least(before + after, F.lit(1.0)) * 0.25 + cap_score(text) * 0.20 + short * 0.15 + indent * 0.05


def roles(ordered: DataFrame) -> DataFrame:
    """Elements in reading order with semantic_role and role_confidence, from several signals."""
    rows = _page_stats(gaps(ordered)).withColumn("__t", strip(F.col("content")))
    text = F.col("__t")
    rows = rows.withColumn("__s", heading_score(text))
    score, n = F.col("__s"), F.length(text)
    bullet = F.instr(F.lit(BULLETS), F.substring(text, 1, 1)) > 0
    small = (F.col("y0") > F.col("page_h") * 0.85) & (F.col("y1") - F.col("y0") < F.col("avg_h") * 0.8)
    lettered = (n > 2) & text.rlike(r"^\p{L}[.):] ") & (n < 80)
    is_ = lambda role, sure: F.struct(F.lit(role).alias("r"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("c"))
    verdict = (
        F.when(n == 0, is_("paragraph", 0.5))
        .when(bullet, is_("list_item", 0.95))
        .when(text.rlike(r"^\d+[.):] ") & (n < 80), is_("list_item", 0.9))
        .when(lettered, is_("list_item", 0.85))
        .when(_caption(text), is_("caption", 0.85))
        .when(small, is_("footnote", 0.8))
        .when(score >= 0.45, is_("heading", score))
        .otherwise(is_("paragraph", 1.0 - score))
    )
    return rows.withColumn("__v", verdict).select(*ordered.columns, F.col("__v.r").alias("semantic_role"), F.col("__v.c").alias("role_confidence"))


def roles_by_size(ordered: DataFrame) -> DataFrame:
    """Elements with semantic_role from size and first characters alone."""
    rows = _page_stats(ordered).withColumn("__t", strip(F.col("content")))
    text, h = F.col("__t"), F.col("y1") - F.col("y0")
    role = (
        F.when(F.length(text) == 0, "paragraph")
        .when((F.length(text) < 100) & (h > F.col("avg_h") * 1.2), "heading")
        .when(F.instr(F.lit(LEGACY_BULLETS), F.substring(text, 1, 1)) > 0, "list_item")
        .when(text.rlike(r"^\d[.):] "), "list_item")
        .when(_caption(text), "caption")
        .when((F.col("y0") > F.col("page_h") * 0.85) & (h < F.col("avg_h") * 0.8), "footnote")
        .otherwise("paragraph")
    )
    return rows.select(*ordered.columns, role.alias("semantic_role"))


def page_layout(elements: DataFrame, threshold: float = 0.7, gap: float = 50) -> DataFrame:
    """Text elements with column_id, reading_order, semantic_role and role_confidence; uncertain ones come last, as paragraphs in their order."""
    marked = split_by_confidence(elements.filter("elem_type = 'text'"), threshold)
    sure = roles(reading_order(assign_columns(marked.filter("not uncertain"), gap=gap)))
    unsure = marked.filter("uncertain")
    counts = sure.groupBy(*PAGE).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*PAGE).orderBy("elem_idx")
    tail = unsure.withColumn("k", F.row_number().over(w)).join(counts, PAGE, "left")
    tail = tail.withColumn("reading_order", F.coalesce("n", F.lit(0)) + F.col("k")).withColumn("semantic_role", F.lit("paragraph"))
    return sure.unionByName(tail.drop("n", "k"), allowMissingColumns=True)
