"""Markdown in other forms: paragraphs with styles, HTML blocks, merged lines, service answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import markdown_to_text, strip, words
from folioscope.operators.enforce import line_view


def docx_blocks(df: DataFrame, key: str, md: str = "md", bullets: bool = True) -> DataFrame:
    """(key, line_no, style, text): headings, bullets and paragraphs of non-blank lines."""
    rows = line_view(df, key, md).withColumn("t", strip(F.col("line")) if bullets else F.col("line")).filter(strip(F.col("line")) != "")
    t = F.col("t")
    item = t.rlike(r"^[-*] ") if bullets else F.lit(False)
    style = F.when(t.rlike("^# "), "heading1").when(t.rlike("^## "), "heading2").when(t.rlike("^### "), "heading3").when(item, "bullet").otherwise("paragraph")
    text = F.when(style == "paragraph", t).otherwise(F.regexp_replace(t, r"^(#{1,3}|[-*]) ", ""))
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), style.alias("style"), text.alias("text"))


def html_lines(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, line_no, tag, html): each non-blank line as an element; comments and fences are left out."""
    rows = line_view(df, key, md).withColumn("t", strip(F.col("line"))).filter("t <> '' and t not like '<!--%' and t not like '```%'")
    t = F.col("t")
    level = F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    tag = F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).when(t.rlike(r"^[-*+]\s"), "li").when(F.startswith(t, F.lit("|")), "tr").otherwise("p")
    body = F.regexp_replace(t, r"^(#{1,6}|[-*+])\s+", "")
    safe = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = F.regexp_replace(F.regexp_replace(safe, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    linked = F.regexp_replace(marked, r"\[(.+?)\]\((.+?)\)", '<a href="$2">$1</a>')
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), tag.alias("tag"), F.concat(F.lit("<"), tag, F.lit(">"), linked, F.lit("</"), tag, F.lit(">")).alias("html"))


def defragment(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, md): lines that don't end a sentence joined to the next; blank lines stay."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = line_view(df, key, md).withColumn("t", strip(F.col("line")))
    before = F.lag("t").over(w)
    starts = before.isNull() | (F.col("t") == "") | (before == "") | before.rlike(r"[.?!:]$")
    runs = rows.withColumn("run", F.sum(starts.cast("long")).over(w)).groupBy(key, "run").agg(F.sort_array(F.collect_list(F.struct("line_no", "t"))).alias("xs"))
    merged = runs.select(key, "run", F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias("p"))
    return merged.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "p"))).alias("ps")).select(key, F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("md"))


def response(md: Column, filename: Column, method: Column, export_format: str = "markdown") -> Column:
    """The answer of the conversion service as JSON."""
    content = markdown_to_text(md, code=True) if export_format == "txt" else md
    stats = F.struct(F.size(words(md)).alias("words"), F.length(md).alias("characters"))
    return F.to_json(F.struct(F.lit(True).alias("success"), filename.alias("filename"), method.alias("method"), F.lit(export_format).alias("format"), content.alias("content"), stats.alias("stats")))


def write_markdown(df: DataFrame, path: str, key: str, md: str = "md") -> None:
    """One folder per document below path, as text."""
    df.select(F.col(key).cast("string").alias(key), F.col(md).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
