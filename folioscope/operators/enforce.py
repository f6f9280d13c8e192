"""Markdown brought to one schema: front matter, page markers, roles, headings, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import clean_ends, clean_inner, front_matter, has_front_matter, least_level, let, one_end, shift_headings, strip

PAGE_MARK = r"<!--\s*page:\s*(\d+)\s*-->"
ROLE_MARK = r"<!--\s*role:(\w+)(?:\s+[^>]+)?\s*-->"
REQUIRED = ["source_file", "document_id"]


def _field(name: str, value: Column, quoted: bool = True) -> Column:
    """A line of front matter, null where the value is."""
    return F.concat(F.lit(f'  {name}: "' if quoted else f"  {name}: "), value, F.lit('"' if quoted else ""))


def front_matter_block(df: DataFrame) -> Column:
    """The front matter of a row's metadata columns, those that it has: source_file, document_id, pages, extraction_method, extraction_date, language,
    confidence_score, confidence_avg, confidence_min, uncertain_regions, detected_columns, has_tables, has_figures, title, author, creation_date."""
    have = set(df.columns)
    col = lambda n, default=None: (F.coalesce(F.col(n).cast("string"), F.lit(default)) if default is not None else F.col(n).cast("string")) if n in have else F.lit(default).cast("string")
    fixed = lambda n: F.when(F.col(n).isNotNull(), F.format_string("%.4f", F.col(n).cast("double"))) if n in have else F.lit(None).cast("string")
    section = lambda title, *names: F.when(_any([col(n) for n in names]), F.lit(f"\n{title}:"))
    filled = lambda n: F.when(col(n) != "", col(n))
    return F.concat_ws(
        "\n",
        F.lit("---\ndocument:"),
        _field("source_file", col("source_file", "unknown")),
        _field("document_id", col("document_id", "unknown")),
        _field("pages", col("pages"), False),
        _field("extraction_method", col("extraction_method", "unknown")),
        _field("extraction_date", col("extraction_date")),
        _field("language", col("language", "en")),
        F.lit("\nquality:"),
        _field("confidence_score", F.coalesce(fixed("confidence_score"), F.lit("1.0000")), False),
        _field("confidence_avg", fixed("confidence_avg"), False),
        _field("confidence_min", fixed("confidence_min"), False),
        _field("uncertain_regions", col("uncertain_regions"), False),
        section("layout", "detected_columns", "has_tables", "has_figures"),
        _field("detected_columns", col("detected_columns"), False),
        _field("has_tables", col("has_tables"), False),
        _field("has_figures", col("has_figures"), False),
        section("metadata", "title", "author", "creation_date"),
        _field("title", filled("title")),
        _field("author", filled("author")),
        _field("creation_date", filled("creation_date")),
        F.lit("---\n"),
    )


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNotNull()
    return out


def front_matter_flat(df: DataFrame, method: Column | None = None, score: Column | None = None, language: Column | None = None) -> Column:
    """The older front matter: document and metadata sections; `dimensions` and `format` where a row has a width and no pages."""
    have = set(df.columns)
    col = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")
    filled = lambda n: F.when(col(n) != "", col(n))
    pages = F.col("pages").cast("string") if "pages" in have else F.lit(None).cast("string")
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")) if "width" in have else F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        F.lit("---\ndocument:"),
        _field("source_file", col("source_file")),
        _field("pages", pages, False),
        _field("dimensions", F.when(pages.isNull(), size)),
        _field("format", F.when(pages.isNull() & size.isNotNull(), col("format"))),
        _field("extraction_method", method) if method is not None else F.lit(None).cast("string"),
        _field("extraction_date", col("extraction_date")),
        _field("confidence_score", F.format_string("%.2f", score), False) if score is not None else F.lit(None).cast("string"),
        _field("language", language if language is not None else F.lit("en")),
        _field("document_id", col("document_id")),
        F.lit("\nmetadata:"),
        *[_field(n, filled(n)) for n in ("title", "author", "subject", "creator", "creation_date")],
        F.lit("---\n"),
    )


def line_end(text: Column, start: Column) -> Column:
    """Where the first line end at or after `start` is, counted from 1; 0 if there is none."""
    found = F.instr(F.substr(text, F.greatest(start, F.lit(1))), F.lit("\n"))
    return F.when(found > 0, found + F.greatest(start, F.lit(1)) - 1).otherwise(0)


def _closed(md: Column) -> Column:
    """The first character after the line that ends the front matter, counted from 1; 0 where none does."""
    end = F.locate("\n---\n", md, 4)
    return F.when(F.startswith(md, F.lit("---")) & (end > 0), end + 5).otherwise(0)


def with_front_matter(md: Column, block: Column) -> Column:
    """md with the block before it, or in place of front matter that lacks a required field."""
    end = _closed(md)
    own = F.substr(md, F.lit(4), F.greatest(end - 8, F.lit(0)))
    lacks = F.lit(False)
    for name in REQUIRED:
        lacks = lacks | ~F.contains(own, F.lit(f"{name}:"))
    replaced = F.concat(block, F.substr(md, F.greatest(end, F.lit(1))))
    return F.when(~has_front_matter(md), F.concat(block, F.lit("\n"), md)).when((end > 0) & lacks, replaced).otherwise(md)


def _turned(md: Column) -> Column:
    """md with `## Page N` headings as page markers."""
    return F.regexp_replace(md, r"(?md)^##\s+Page\s+(\d+)\s*$", "<!-- page:$1 -->")


def _first_page(turned: Column) -> Column:
    """With a marker of page 1 after the front matter or at the top."""
    dashes = F.locate("---", turned, 4)
    after = line_end(turned, dashes)
    inserted = F.concat(F.substr(turned, F.lit(1), after), F.lit("\n<!-- page:1 -->\n"), F.substr(turned, after + 1))
    return F.when(dashes > 1, inserted).otherwise(F.concat(F.lit("<!-- page:1 -->\n\n"), turned))


def ensure_page_markers(md: Column) -> Column:
    """md with at least one page marker: from `## Page N` headings, else page 1 after the front matter or at the top."""
    turned = _turned(md)
    return F.when(md.rlike(PAGE_MARK), md).when(turned.rlike(PAGE_MARK), turned).otherwise(_first_page(turned))


def annotate_lines(md: Column) -> Column:
    """md with a role marker before each heading and table row that has none just before it."""

    def mark(line: Column, above: Column) -> Column:
        return let(strip(line), lambda own: marked(line, own, above))

    def marked(line: Column, own: Column, above: Column) -> Column:
        plain = (own == "") | F.startswith(own, F.lit("---")) | F.startswith(own, F.lit("<!--")) | F.startswith(strip(above), F.lit("<!-- role:"))
        level = F.length(F.regexp_extract(own, "^(#*)", 1)).cast("string")
        return (
            F.when(plain, line)
            .when(F.startswith(own, F.lit("#")), F.concat(F.lit("<!-- role:heading level:"), level, F.lit(" -->\n"), line))
            .when(F.startswith(own, F.lit("|")), F.concat(F.lit("<!-- role:table -->\n"), line))
            .otherwise(line)
        )

    # Each line beside the one above it.
    return let(F.split(md, "\n"), lambda lines: F.array_join(F.zip_with(lines, F.slice(F.concat(F.array(F.lit("")), lines), F.lit(1), F.size(lines)), mark), "\n"))


def format_rows(rows: Column) -> Column:
    """An array of table rows as an array with cells padded to their column's width; a single row stays."""
    rule = r"^:?-+:?$"
    cell = lambda r, j: F.coalesce(F.get(r, j), F.lit(""))
    sized = lambda r, j: F.when((F.size(r) > j) & ~cell(r, j).rlike(rule), F.length(cell(r, j))).otherwise(3)
    pad = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(n - F.length(c), F.lit(0))))

    def widths(parsed: Column) -> Column:
        columns = F.sequence(F.lit(0), F.array_max(F.transform(parsed, lambda r: F.size(r))) - 1)
        return F.transform(columns, lambda j: F.greatest(F.lit(3), F.array_max(F.transform(parsed, lambda r: sized(r, j)))))

    def line(r: Column, i: Column, wide: Column) -> Column:
        cells = F.transform(wide, lambda n, j: F.when((i == 1) & cell(r, j).rlike(rule), F.repeat(F.lit("-"), n)).otherwise(pad(cell(r, j), n)))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    parsed = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|", -1), lambda c: strip(c)))
    formatted = let(parsed, lambda p: let(widths(p), lambda wide: F.transform(p, lambda r, i: line(r, i, wide))))
    return F.when(F.size(rows) < 2, rows).otherwise(formatted)


def line_view(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, line_no, line)."""
    return df.select(key, F.posexplode(F.split(md, "\n")).alias("line_no", "line"))


def table_blocks(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, first_line, n_rows, rows): runs of lines that begin and end with a bar."""
    lines = line_view(df, key, md).withColumn("line", strip(F.col("line"))).filter(r"line rlike '^\\|.*\\|$' or line = '|'")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    runs = lines.withColumn("island", island).groupBy(key, "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("xs"))
    return runs.select(key, F.get("xs", F.lit(0))["line_no"].alias("first_line"), F.size("xs").alias("n_rows"), F.transform("xs", lambda x: x["line"]).alias("rows"))


def format_tables(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """df with each run of table rows formatted: a run becomes one piece, and pieces are joined in order."""
    lines = line_view(df, key, md).withColumn("own", strip(F.col("line"))).withColumn("bar", F.col("own").rlike(r"^\|.*\|$") | (F.col("own") == "|"))
    w = Window.partitionBy(key).orderBy("line_no")
    starts = ~F.col("bar") | ~F.coalesce(F.lag("bar").over(w), F.lit(False))
    runs = lines.withColumn("run", F.sum(starts.cast("long")).over(w))
    grouped = runs.groupBy(key, "run").agg(F.sort_array(F.collect_list(F.struct("line_no", F.when(F.col("bar"), F.col("own")).otherwise(F.col("line")).alias("t")))).alias("xs"), F.max("bar").alias("bar"))
    rows = F.transform("xs", lambda x: x["t"])
    pieces = grouped.select(key, "run", F.array_join(F.when(F.col("bar"), format_rows(rows)).otherwise(rows), "\n").alias("p"))
    joined = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "p"))).alias("ps"))
    return df.drop(md).join(joined.select(key, F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias(md)), key)


def enforce(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """df with md brought to the schema; metadata columns of df fill the front matter."""
    first = df.withColumn(md, with_front_matter(F.col(md), front_matter_block(df)))
    marked = first.withColumn(md, ensure_page_markers(F.col(md)))
    lined = marked.withColumn(md, shift_headings(annotate_lines(F.col(md))))
    tabled = format_tables(lined, key, md)
    return tabled.withColumn(md, clean_ends(F.col(md)))


def format_runs(md: Column) -> Column:
    """md with each run of table rows formatted, as format_tables() does, within a row: for texts of a page's size."""

    def whole(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(at, lambda i: ~(F.get(lines, i)["bar"] & F.coalesce(F.get(lines, i - 1)["bar"], F.lit(False))))
        return let(F.struct(lines.alias("lines"), starts.alias("starts")), pieces)

    def pieces(x: Column) -> Column:
        run = lambda s, j: F.transform(F.slice(x["lines"], s + 1, F.coalesce(F.get(x["starts"], j + 1), F.size(x["lines"])) - s), lambda y: y["t"])
        return F.array_join(F.transform(x["starts"], lambda s, j: F.when(F.get(x["lines"], s)["bar"], F.array_join(format_rows(run(s, j)), "\n")).otherwise(F.get(x["lines"], s)["t"])), "\n")

    bar = lambda own: own.rlike(r"^\|.*\|$") | (own == "|")
    judged = lambda line, own: F.struct(bar(own).alias("bar"), F.when(bar(own), own).otherwise(line).alias("t"))
    return let(F.transform(F.split(md, "\n"), lambda line: let(strip(line), lambda own: judged(line, own))), whole)


def _levels(md: Column) -> Column:
    """Whether a piece has a page marker, and the least level of its headings: with `## Page N` as it is, and as a marker."""
    each = lambda text: F.struct(text.rlike(PAGE_MARK).alias("marked"), least_level(F.split(text, "\n")).alias("least"))
    return F.struct(each(md).alias("own"), each(_turned(md)).alias("turned"))


def documents_of(pages: DataFrame, fields: DataFrame, key: str, order: str, md: str = "md") -> DataFrame:
    """fields (key and metadata, one row a document) with the front matter and what enforce_pieces() must know of the whole document: the last page, how pages are marked, the least heading level."""
    found = pages.filter(F.col(md).isNotNull()).select(key, order, _levels(F.substr(F.col(md), F.lit(2))).alias("x"))
    ways = [F.struct(F.bool_or(f"x.{w}.marked").alias("marked"), F.min(f"x.{w}.least").alias("least")).alias(f"pages_{w}") for w in ("own", "turned")]
    front = fields.withColumn("front", F.concat(front_matter_block(fields), F.lit("\n"))).withColumn("x", _levels(F.col("front")))
    rows = front.join(found.groupBy(key).agg(F.max(order).alias("last"), *ways), key, "left")
    marked = lambda w: F.col(f"x.{w}.marked") | F.coalesce(F.col(f"pages_{w}.marked"), F.lit(False))
    least = lambda w: F.least(F.col(f"x.{w}.least"), F.col(f"pages_{w}.least"))
    way = F.when(marked("own"), "own").when(marked("turned"), "turned").otherwise("none")
    return rows.select(*fields.columns, "front", "last", way.alias("way"), F.when(marked("own"), least("own")).otherwise(least("turned")).alias("least"))


def enforce_pieces(pages: DataFrame, documents: DataFrame, key: str, order: str, md: str = "md") -> DataFrame:
    """(key, metadata, order, md): what enforce() makes of a document's pages in a row, in pieces of a page; the front matter has no number and comes first.

    pages (key, order, md): each begins with a line end and a comment, as pages_markdown() has it, and the front matter ends with lines of
    its own. So no match, table or run of line ends goes on from piece to piece; what a whole document decides is in documents_of().
    """
    about = ["last", "way", "least"]
    fields = [c for c in documents.columns if c not in (key, "front", *about)]
    first = documents.select(key, *fields, *about, F.lit(None).cast(pages.schema[order].dataType).alias(order), F.col("front").alias(md))
    rest = pages.filter(F.col(md).isNotNull()).select(key, order, F.substr(F.col(md), F.lit(2)).alias(md)).join(documents.drop("front"), key)
    text, last = F.col(md), F.col(order).eqNullSafe(F.col("last"))
    marked = F.when(F.col("way") == "own", text).when(F.col(order).isNull() & (F.col("way") == "none"), _first_page(_turned(text))).otherwise(_turned(text))
    tabled = format_runs(shift_headings(annotate_lines(marked), F.col("least")))
    whole = let(clean_inner(F.concat(tabled, F.when(last, "").otherwise("\n"))), lambda x: F.when(last, one_end(x)).otherwise(x))
    return first.unionByName(rest).select(key, *fields, order, whole.alias(md))


def violations(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, type): what enforce() would have to mend."""
    text = F.col(md)
    end = _closed(text)
    own = F.substr(text, F.lit(4), F.greatest(end - 8, F.lit(0)))
    lacks = ~F.contains(own, F.lit("source_file:")) | ~F.contains(own, F.lit("document_id:"))
    turned = F.regexp_replace(text, r"(?md)^##\s+Page\s+(\d+)\s*$", "<!-- page:$1 -->")
    levels = F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^(#{1,6})\s+.+$"), F.lit(1)), lambda x: F.length(x))
    kinds = F.array_compact(
        F.array(
            F.when(~has_front_matter(text), F.lit("missing_frontmatter")),
            F.when((end > 0) & lacks, F.lit("missing_fields")),
            F.when(~text.rlike(PAGE_MARK) & ~turned.rlike(PAGE_MARK), F.lit("no_page_markers")),
            F.when(F.coalesce(F.array_min(levels), F.lit(1)) > 1, F.lit("heading_hierarchy")),
        )
    )
    return df.select(key, F.explode(kinds).alias("type"))


def check_only(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, is_valid, missing_page_markers, role_annotations, page_markers) without changing anything."""
    text = F.col(md)
    return df.select(key, has_front_matter(text).alias("is_valid"), (~text.rlike(PAGE_MARK)).alias("missing_page_markers"), F.regexp_count(text, F.lit(ROLE_MARK)).cast("long").alias("role_annotations"), F.regexp_count(text, F.lit(PAGE_MARK)).cast("long").alias("page_markers"))


__all__ = ["annotate_lines", "check_only", "enforce", "ensure_page_markers", "format_rows", "format_tables", "front_matter", "front_matter_block", "front_matter_flat", "line_view", "table_blocks", "violations", "with_front_matter"]
