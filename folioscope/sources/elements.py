"""Page elements and Markdown texts from tables of documents and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an element row holds at most; sources fill what they know and leave the rest null.
ELEMENT_COLUMNS = ["doc_key", "page_num", "elem_idx", "elem_type", "content", "x0", "y0", "x1", "y1", "y", "font_size", "confidence"]


#: Ids of a range within which a source's pages are counted by one task.
PAGE_RANGE = 1 << 16


def numbered_pages(docs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(source, doc_id, text, page_num): the rows of a source by id, from 1 or after the pages that `before` (source, pages) has of it.

    A source can hold most rows, so pages are counted in ranges of ids, and a range starts at the sum of those before it.
    Null ids are a range of their own, the first; ties may go either way.
    """
    rows = docs.select("source", "doc_id", "text").withColumn("part", F.floor(F.col("doc_id") / PAGE_RANGE))
    sizes = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(earlier, F.lit(0)).alias("start"))
    if before is not None:
        done = before.select(F.col("source").alias("d"), "pages")
        starts = starts.join(done, F.col("s").eqNullSafe(F.col("d")), "left").select("s", "p", (F.col("start") + F.coalesce("pages", F.lit(0))).alias("start"))
    at = F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id"))
    joined = rows.withColumn("at", at).join(starts, F.col("source").eqNullSafe(F.col("s")) & F.col("part").eqNullSafe(F.col("p")))
    return joined.select("source", "doc_id", "text", (F.col("start") + F.col("at")).cast("long").alias("page_num"))


def document_lines(docs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row per line of each document: a source is a document, its rows by id are the pages."""
    lines = numbered_pages(docs, before).select(F.col("source").alias("doc_key"), "doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.select("doc_key", "doc_id", "page_num", F.col("line_no").cast("long").alias("elem_idx"), F.trim("raw").alias("raw"), (F.col("doc_id") * 31 + F.col("line_no") * 7).alias("k"))


#: What a line becomes, by k; the same text serves Spark and DuckDB.
CONTENT_SQL = """CASE
  WHEN k % 23 = 0 THEN '| Item | Value |' || chr(10) || '|---|---|' || chr(10) || '| row ' || cast(elem_idx AS STRING) || ' | ' || cast(k % 97 AS STRING) || ' |'
  WHEN k % 29 = 0 THEN '[Figure: 300x200px]'
  WHEN elem_idx = 0 THEN 'Bulletin ' || doc_key
  WHEN k % 11 = 0 THEN 'Page ' || cast(page_num AS STRING)
  WHEN k % 13 = 0 THEN 'Draft copy'
  WHEN k % 17 = 0 THEN '- ' || raw
  WHEN k % 19 = 0 THEN cast(elem_idx AS STRING) || '. ' || raw
  WHEN k % 31 = 0 THEN 'Table ' || cast(elem_idx AS STRING) || ': ' || substring(raw, 1, 40)
  WHEN k % 37 = 0 THEN 'Figure ' || cast(elem_idx AS STRING) || ': ' || substring(raw, 1, 40)
  WHEN k % 41 = 0 THEN '[' || cast(elem_idx AS STRING) || '] ' || raw
  WHEN k % 43 = 0 THEN 'SUMMARY OF FINDINGS'
  WHEN k % 47 = 0 THEN 'It appears that ' || raw
  WHEN k % 53 = 0 THEN '|||---==='
  WHEN k % 59 = 0 THEN '= x+1'
  ELSE raw END"""

COLUMNS_SQL = f"""doc_key, page_num, elem_idx, k,
  CASE WHEN k % 23 = 0 THEN 'table' WHEN k % 29 = 0 THEN 'figure' ELSE 'text' END AS elem_type,
  {CONTENT_SQL} AS content,
  cast(CASE WHEN k % 2 = 0 THEN 50 ELSE 350 END + (k % 3) * 5 AS DOUBLE) AS x0,
  cast(40 + elem_idx * 30 AS DOUBLE) AS y0,
  cast(CASE WHEN k % 2 = 0 THEN 250 ELSE 550 END + (k % 5) * 20 AS DOUBLE) AS x1,
  cast(52 + elem_idx * 30 + CASE WHEN k % 7 = 0 THEN 12 ELSE 0 END AS DOUBLE) AS y1,
  cast(40 + elem_idx * 30 AS DOUBLE) AS y,
  cast(CASE WHEN k % 7 = 0 THEN 20 WHEN k % 5 = 0 THEN 16 ELSE 12 END AS DOUBLE) AS font_size,
  1.0e0 - cast((k * 37) % 71 AS DOUBLE) / 100.0e0 AS confidence"""


def elements(docs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The element table over documents: each line is an element whose type, place and confidence follow from its numbers."""
    lines = document_lines(docs, before)
    return lines.selectExpr(*_split_columns(COLUMNS_SQL)).drop("k")


def _split_columns(sql: str) -> list[str]:
    """Select expressions of a list separated by commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(sql):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and depth == 0 and c == ",":
            out.append(sql[start:i].strip())
            start = i + 1
    return [*out, sql[start:].strip()]


#: Front matter by doc_id % 4: none, complete, without source_file, never closed.
PREFIX_SQL = """CASE doc_id % 4
  WHEN 1 THEN '---' || chr(10) || 'document:' || chr(10) || '  source_file: "' || source || '.pdf"' || chr(10) || '  document_id: "id' || cast(doc_id AS STRING) || '"' || chr(10) || 'quality:' || chr(10) || '  confidence_score: 0.9' || chr(10) || '---' || chr(10)
  WHEN 2 THEN '---' || chr(10) || 'document:' || chr(10) || '  document_id: "id' || cast(doc_id AS STRING) || '"' || chr(10) || '---' || chr(10)
  WHEN 3 THEN '--- ' || chr(10) || 'document:' || chr(10) ELSE '' END"""

#: Markdown of a line, by k.
LINE_SQL = """CASE
  WHEN k % 61 = 0 THEN '<!-- page:' || cast(k % 5 + 1 AS STRING) || ' -->' || chr(10) || raw
  WHEN k % 7 = 0 THEN '<!-- role:heading level:2 -->' || chr(10) || '## ' || raw
  WHEN k % 53 = 0 THEN '### ' || raw
  WHEN k % 5 = 0 THEN '<!-- reading-order:' || cast(elem_idx + 1 AS STRING) || ' -->' || chr(10) || '<!-- role:paragraph -->' || chr(10) || raw
  WHEN k % 11 = 0 THEN '<!-- role:list_item type:ordered -->' || chr(10) || '- ' || raw
  WHEN k % 13 = 0 THEN '<!-- confidence:0.' || cast(40 + k % 30 AS STRING) || ' -->' || chr(10) || '[uncertain: ' || raw || ']'
  WHEN k % 17 = 0 THEN '[low-confidence: ' || raw || ']'
  WHEN k % 19 = 0 THEN '| a | ' || cast(k % 89 AS STRING) || ' |' || chr(10) || '|:--|---|' || chr(10) || '| longer cell | x |'
  WHEN k % 23 = 0 THEN 'see [' || substring(raw, 1, 8) || ']() and [a](b)'
  WHEN k % 29 = 0 THEN 'It appears that this looks like ' || raw
  WHEN k % 31 = 0 THEN 'Based on the image, probably ' || raw
  WHEN k % 37 = 0 THEN '```'
  WHEN k % 41 = 0 THEN '| cut ' || raw
  WHEN k % 43 = 0 THEN '**' || substring(raw, 1, 10) || '** and *' || substring(raw, 1, 5) || '* [x'
  WHEN k % 47 = 0 THEN '<!-- role:odd_one -->' || chr(10) || '<!-- role:table -->'
  WHEN k % 3 = 0 THEN raw || chr(10)
  ELSE raw END"""


def markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, md, page_count, method): each document as Markdown with markers, some of them wrong on purpose."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    marked = lines.select("doc_id", "source", F.col("line_no").cast("long").alias("elem_idx"), F.trim("raw").alias("raw"), (F.col("doc_id") * 31 + F.col("line_no") * 7).alias("k"))
    each = marked.select("doc_id", "source", "elem_idx", F.expr(LINE_SQL).alias("line"))
    joined = each.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list(F.struct("elem_idx", "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("<!-- page:1 -->\n"))
    method = F.expr("CASE doc_id % 5 WHEN 0 THEN 'RapidOCR' WHEN 1 THEN 'OpenRouter (x)' WHEN 2 THEN 'pymupdf4llm' WHEN 3 THEN 'GMFT' ELSE 'other' END")
    return joined.select("doc_id", F.concat(F.expr(PREFIX_SQL), first, body).alias("md"), (F.col("doc_id") % 3 + 1).alias("page_count"), method.alias("method"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, elem_idx, tag, content, font_size): headings, paragraphs, list items and titles of a page in order, outside scripts and styles."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)(<(?:h1|p|li|title|footer)\b[^>]*>[^<]*(?:<(?!/?(?:h1|p|li|title|footer|ul|div|article|body)\b)[^>]*>[^<]*)*)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("elem_idx", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("block", r"(?s)<[^>]*>", ""), r"\s+", " "))
    shown = F.when(tag == "li", F.concat(F.lit("• "), text)).otherwise(text)
    size = F.when(tag == "h1", 24.0).otherwise(12.0)
    return rows.select("page_id", F.col("elem_idx").cast("long").alias("elem_idx"), tag.alias("tag"), shown.alias("content"), size.alias("font_size"))
