"""Validation, scores and the quality gate over Markdown texts: issues as rows, reports as one row per document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.patterns import COMMENTARY_BASE, COMMENTARY_FRAMEWORK, COMMENTARY_TYPED, LLM_ROLES, OCR_ROLES
from folioscope.functions.scalars import method_points, quality_level
from folioscope.functions.text import front_matter, has_front_matter, in_sequence, numbers_of, strip, strip_comments, words
from folioscope.operators.enforce import PAGE_MARK, line_end, line_view

ISSUE = "severity string, category string, message string"
ROLE, HEAD, BAR = r"<!--\s*role:\w+", r"(?md)^#{1,6}\s+", r"(?md)^\|"


def _issue(severity: str, category: str, message: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _count(md: Column, pattern: str) -> Column:
    return F.regexp_count(md, F.lit(pattern)).cast("long")


def _explode(df: DataFrame, key: str, checks: list[tuple[Column, Column]]) -> DataFrame:
    """One row for each check that holds."""
    found = F.array_compact(F.array(*[F.when(c, i) for c, i in checks]))
    return df.select(key, F.explode(found).alias("i")).select(key, "i.*")


def schema_issues(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, severity, category, message) of front matter, page markers and roles."""
    text = F.col(md)
    has, block = has_front_matter(text), front_matter(text)
    lacks = lambda word: has & block.isNotNull() & ~F.contains(block, F.lit(word))
    pages = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1)), lambda x: x.cast("long"))
    expected = F.when(F.array_max(pages) >= 1, F.sequence(F.lit(1).cast("long"), F.array_max(pages)))
    missing = F.array_except(expected, pages)
    roles, heads, bars = _count(text, ROLE), _count(text, HEAD), F.floor(_count(text, BAR) / 2)
    low = F.concat(F.lit("Low annotation coverage: "), roles.cast("string"), F.lit(" annotations for "), heads.cast("string"), F.lit(" headings and "), bars.cast("string"), F.lit(" tables"))
    gap = F.concat(F.lit("Missing page markers: ["), F.array_join(missing, ", "), F.lit("]"))
    return _explode(df, key, _schema_checks(has, block.isNotNull(), lacks, F.size(pages) == 0, F.coalesce(F.size(missing) > 0, F.lit(False)), gap, roles, heads, bars, low))


def _schema_checks(has: Column, closed: Column, lacks: Callable[[str], Column], unpaged: Column, gaps: Column, gap: Column | str, roles: Column, heads: Column, bars: Column, low: Column | str) -> list[tuple[Column, Column]]:
    return [
        (~has, _issue("error", "schema", "Missing YAML frontmatter")),
        (has & ~closed, _issue("error", "schema", "Incomplete YAML frontmatter (missing closing ---)")),
        (lacks("document:"), _issue("error", "schema", "Missing document section in frontmatter")),
        (lacks("source_file:"), _issue("warning", "schema", "Missing source_file in frontmatter")),
        (lacks("quality:"), _issue("warning", "schema", "Missing quality section in frontmatter")),
        (unpaged, _issue("warning", "schema", "No page markers found")),
        (gaps, _issue("warning", "schema", gap)),
        (roles < (heads + bars) * 0.5, _issue("warning", "schema", low)),
    ]


def body_lines(md: Column) -> Column:
    """Lines after the front matter that are neither blank nor comments."""
    dashes = F.locate("---", md, 4)
    after = F.when(F.startswith(md, F.lit("---")) & (dashes > 1), line_end(md, dashes)).otherwise(0)
    return F.filter(F.split(F.substr(md, after + 1), "\n"), lambda x: (strip(x) != "") & ~F.startswith(strip(x), F.lit("<!--")))


def content_issues(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    text = F.col(md)
    return _explode(df, key, _content_checks(F.size(body_lines(text)), _count(text, UNSURE), _count(text, LOW), _first_level(text)))


UNSURE, LOW = r"\[uncertain:", r"\[low-confidence:"


def _first_level(md: Column) -> Column:
    return F.length(F.regexp_extract(md, r"(?md)^(#{1,6})\s+", 1))


def _content_checks(n: Column, unsure: Column, low: Column, first: Column) -> list[tuple[Column, Column]]:
    start = F.concat(F.lit("Document does not start with H1 (starts with H"), first.cast("string"), F.lit(")"))
    return [
        (n < 3, _issue("error", "content", "Document appears to have very little content")),
        (unsure > n * 0.3, _issue("warning", "content", F.concat(F.lit("High uncertainty: "), unsure.cast("string"), F.lit(" uncertain regions")))),
        (low > n * 0.1, _issue("warning", "content", F.concat(F.lit("Many low-confidence regions: "), low.cast("string")))),
        (first > 1, _issue("info", "content", start)),
    ]


def _any_of(line: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [line.rlike("(?i)" + p) for p in patterns])


def commentary_lines(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, line, context): lines with a phrase of a commenting model, one row each."""
    lines = line_view(df, key, md).filter(_any_of(F.col("line"), COMMENTARY_FRAMEWORK))
    return lines.select(key, (F.col("line_no") + 1).cast("long").alias("line"), F.substring("line", 1, 80).alias("context"))


def commentary_patterns(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, line, pattern, text): one row for each line and pattern, comments included."""
    hits = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.col("line").rlike("(?i)" + p).alias("h")) for p in COMMENTARY_BASE]), lambda x: x["h"])
    rows = line_view(df, key, md).select(key, "line_no", "line", F.explode(hits).alias("x"))
    return rows.select(key, (F.col("line_no") + 1).cast("long").alias("line"), F.col("x.p").alias("pattern"), strip(F.col("line")).alias("text"))


def commentary_matches(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, line, subtype, matched_phrase): every match of every typed pattern, comment lines left out."""
    def matches(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit("(?i)" + pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("subtype"), m.alias("matched_phrase")))

    found = F.flatten(F.array(*[matches(p, kind) for p, kind in COMMENTARY_TYPED]))
    rows = line_view(df, key, md).filter(~F.startswith(strip(F.col("line")), F.lit("<!--")))
    return rows.select(key, (F.col("line_no") + 1).cast("long").alias("line"), F.explode(found).alias("x")).select(key, "line", "x.subtype", "x.matched_phrase")


def _is_long(line: Column) -> Column:
    return (F.length(line) > 500) & ~F.startswith(line, F.lit("|"))


def _is_cut(line: Column) -> Column:
    return F.startswith(strip(line), F.lit("|")) & ~F.endswith(strip(line), F.lit("|"))


def format_issues(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, severity, category, message, line): very long lines and table rows without a closing bar."""
    rows = line_view(df, key, md)
    line = F.col("line")
    long, cut = _is_long(line), _is_cut(line)
    found = F.array_compact(F.array(F.when(long, _issue("info", "format", F.concat(F.lit("Very long line ("), F.length(line).cast("string"), F.lit(" chars)")))), F.when(cut, _issue("warning", "format", "Incomplete table row"))))
    return rows.select(key, (F.col("line_no") + 1).cast("long").alias("line"), F.explode(found).alias("i")).select(key, "i.*", "line")


def issues(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, severity, category, message, line, context): all checks of the framework."""
    talk = commentary_lines(df, key, md).withColumns({"severity": F.lit("error"), "category": F.lit("hallucination"), "message": F.lit("Potential hallucination detected")})
    parts = [schema_issues(df, key, md), content_issues(df, key, md), talk, format_issues(df, key, md)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(key, "severity", "category", "message", "line", "context")


def issue_summary(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key, "severity", "category").agg(F.count("*").alias("n"))


def report(df: DataFrame, key: str, md: str = "md", strict: bool = False) -> DataFrame:
    """One row per text: counts, score and validity; a text that isn't strict is always valid."""
    of = lambda column, value: F.count_if(F.col(column) == value)
    counted = issues(df, key, md).groupBy(key).agg(
        of("severity", "error").alias("errors"),
        of("severity", "warning").alias("warnings"),
        of("severity", "info").alias("infos"),
        of("category", "hallucination").alias("hallucination_count"),
        of("category", "schema").alias("schema_issues"),
        of("category", "content").alias("content_issues"),
        of("category", "format").alias("format_issues"),
    )
    names = [c for c in counted.columns if c != key]
    return _report(df.select(key).join(counted, key, "left").fillna(0, names), key, names, strict)


def _report(rows: DataFrame, key: str, names: list[str], strict: bool) -> DataFrame:
    score = 1.0 - F.col("errors") * 0.15 - F.col("warnings") * 0.05 - F.col("infos") * 0.01
    valid = (F.col("errors") == 0) if strict else F.lit(True)
    return rows.select(key, valid.alias("is_valid"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("quality_score"), *names, (F.col("hallucination_count") > 0).alias("hallucination_detected"))


def _of_gate(md: Column) -> Column:
    """The number of lines that the gate counts."""
    return F.size(F.filter(F.split(md, "\n"), lambda x: (strip(x) != "") & ~F.startswith(x, F.lit("---")) & ~F.startswith(x, F.lit("<!--"))))


def report_pieces(pieces: DataFrame, key: str, order: str, md: str = "md", strict: bool = False) -> DataFrame:
    """report() of each key's pieces in a row, as enforce_pieces() makes them, with the content_lines of gate(). A piece is whole lines, and a match lies in one piece."""
    text = F.col(md)
    lines = lambda holds: F.size(F.filter(F.split(text, "\n"), holds)).cast("long")
    first, block = F.col(order).isNull(), front_matter(text)
    fields = ["document:", "source_file:", "quality:"]
    sums = {"roles": _count(text, ROLE), "heads": _count(text, HEAD), "bars": _count(text, BAR), "unsure": _count(text, UNSURE), "low": _count(text, LOW), "body": F.size(body_lines(text)), "content_lines": _of_gate(text)}
    sums |= {"talk": lines(lambda x: _any_of(x, COMMENTARY_FRAMEWORK)), "long": lines(_is_long), "cut": lines(_is_cut)}
    front = {"has": has_front_matter(text), "closed": block.isNotNull()} | {f"lacks_{k}": ~F.contains(block, F.lit(f)) for k, f in enumerate(fields)}
    level = F.when(_first_level(text) > 0, F.struct(F.col(order).alias("o"), _first_level(text).alias("n"))).alias("level")
    # Counted in rows of their own, so that no text is sorted with them.
    each = pieces.select(key, *[c.alias(n) for n, c in sums.items()], *[F.when(first, c).alias(n) for n, c in front.items()], level)
    rows = each.groupBy(key).agg(*[F.sum(n).alias(n) for n in sums], *[F.bool_or(n).alias(n) for n in front], F.min("level").alias("level"))
    marks = pieces.select(key, F.explode(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))).alias("p")).select(key, F.col("p").cast("long").alias("p")).distinct()
    rows = rows.join(marks.groupBy(key).agg(F.max("p").alias("most"), F.count_if(F.col("p") >= 1).alias("marked")), key, "left")
    c = F.col
    lacks = lambda word: c("has") & c("closed") & c(f"lacks_{fields.index(word)}")
    schema = _schema_checks(c("has"), c("closed"), lacks, c("marked").isNull(), (c("most") >= 1) & (c("marked") < c("most")), "", c("roles"), c("heads"), F.floor(c("bars") / 2), "")
    content = _content_checks(c("body"), c("unsure"), c("low"), F.coalesce(c("level.n"), F.lit(0)))
    held = rows.withColumn("s", F.array_compact(F.array(*[F.when(x, i) for x, i in schema]))).withColumn("c", F.array_compact(F.array(*[F.when(x, i) for x, i in content])))
    of = lambda severity: F.size(F.filter(F.concat("s", "c"), lambda i: i["severity"] == severity)).cast("long")
    counted = held.select(
        key,
        (of("error") + c("talk")).alias("errors"),
        (of("warning") + c("cut")).alias("warnings"),
        (of("info") + c("long")).alias("infos"),
        c("talk").alias("hallucination_count"),
        F.size("s").cast("long").alias("schema_issues"),
        F.size("c").cast("long").alias("content_issues"),
        (c("long") + c("cut")).alias("format_issues"),
        "content_lines",
    )
    return _report(counted, key, [n for n in counted.columns if n != key], strict)


def gate(df: DataFrame, reports: DataFrame, key: str, md: str = "md", min_score: float = 0.6, max_commentary: int = 0, max_errors: int = 2, min_lines: int = 5) -> DataFrame:
    """(key, passed, n_failures, content_lines, quality_level, suggested_action) by the gate's limits."""
    return gated(reports.join(df.select(key, _of_gate(F.col(md)).alias("content_lines")), key), key, min_score, max_commentary, max_errors, min_lines)


def gated(rows: DataFrame, key: str, min_score: float = 0.6, max_commentary: int = 0, max_errors: int = 2, min_lines: int = 5) -> DataFrame:
    """gate() of reports with content_lines."""
    score, talk = F.col("quality_score"), F.col("hallucination_count")
    failed = (score < min_score).cast("int") + (talk > max_commentary).cast("int") + (F.col("errors") > max_errors).cast("int") + (F.col("content_lines") < min_lines).cast("int")
    action = F.when(F.col("n_failures") == 0, "accept").when(talk > 0, "fallback_to_local_ocr").when(score < 0.3, "reject_and_retry").when(score < 0.5, "fallback_to_alternative").otherwise("accept_with_warnings")
    rows = rows.withColumn("n_failures", failed)
    return rows.select(key, (F.col("n_failures") == 0).alias("passed"), "n_failures", "content_lines", quality_level(score).alias("quality_level"), action.alias("suggested_action"))


def syntax(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, syntax_valid, empty_links, unclosed_code, unmatched_brackets)."""
    text = F.col(md)
    signs = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    odd = F.size(F.filter(F.split(text, "\n"), lambda x: signs(x, "[") != signs(x, "]")))
    empty = F.aggregate(F.transform(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(r"\[([^\]]+)\]\(\)"))), F.lit(0), lambda a, b: a + b)
    open_code = (_count(text, "```") % 2) != 0
    return df.select(key, ((empty == 0) & ~open_code).alias("syntax_valid"), empty.cast("long").alias("empty_links"), open_code.alias("unclosed_code"), odd.cast("long").alias("unmatched_brackets"))


def compliance(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, compliant, malformed, missing_warnings, has_annotations): missing fields and roles only warn."""
    text = F.col(md)
    has, block = has_front_matter(text), front_matter(text)
    lacks = sum(((has & block.isNotNull() & ~F.contains(F.coalesce(block, F.lit("")), F.lit(w))).cast("long") for w in ("document:", "source_file:", "document_id:")), F.lit(0).cast("long"))
    annotated = text.rlike(r"<!-- role:\w+ -->")
    return df.select(key, (has & block.isNotNull()).alias("compliant"), (has & block.isNull()).alias("malformed"), ((~has).cast("long") + lacks + (~annotated).cast("long")).alias("missing_warnings"), annotated.alias("has_annotations"))


def _score(method: Column, confidence: Column, missing_times: int) -> Column:
    """Points of 100 from the columns of syntax(), compliance() and the text."""
    text = F.col("md")
    wrong = F.col("empty_links") + F.col("unclosed_code").cast("long")
    own = F.when(F.col("syntax_valid"), 30).otherwise(F.greatest(F.lit(0), 30 - wrong * 5))
    schema = F.when(F.col("compliant"), 20).otherwise(F.greatest(F.lit(0), 20 - F.col("missing_warnings") * missing_times * 5))
    has = lambda hit, points: F.when(hit, points).otherwise(0)
    rich = has(text.rlike(r"(?md)^#{1,6}\s"), 5) + has(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")), 7) + has(text.rlike(r"(?md)^[\-*+]\s"), 4) + has(F.contains(text, F.lit("*")), 4)
    sure = F.coalesce(confidence * 10, F.lit(5.0))
    return F.least(F.lit(1.0), (own + schema + rich + method_points(method) + sure) / 100.0)


def base_scores(df: DataFrame, key: str, method: Column, confidence: Column | None = None, missing_times: int = 1) -> DataFrame:
    """(key, quality_score). missing_times 2: as the full report has it, which counts each missing warning twice."""
    joined = df.join(syntax(df, key), key).join(compliance(df, key), key)
    confidence = confidence if confidence is not None else F.lit(None).cast("double")
    return joined.select(key, F.round(_score(method, confidence, missing_times), 6).alias("quality_score"))


def base_report(df: DataFrame, key: str, method: Column) -> DataFrame:
    """One row per text: score, validity, numbers of issues, warnings (each counted twice, as both passes add theirs) and commentary, words and lines."""
    joined = df.join(syntax(df, key), key).join(compliance(df, key), key).join(commentary_patterns(df, key).groupBy(key).agg(F.count("*").alias("marks")), key, "left")
    warnings = (F.col("missing_warnings") + F.col("unmatched_brackets")) * 2
    wrong = F.col("empty_links") + F.col("unclosed_code").cast("long") + F.col("malformed").cast("long")
    score = _score(method, F.lit(None).cast("double"), 2)
    return joined.select(
        key,
        F.round(score, 6).alias("quality_score"),
        "syntax_valid",
        F.col("compliant").alias("schema_compliant"),
        wrong.alias("n_issues"),
        warnings.alias("n_warnings"),
        F.coalesce("marks", F.lit(0)).alias("n_markers"),
        F.size(words(F.col("md"))).alias("word_count"),
        F.size(F.split("md", "\n")).alias("line_count"),
    )


def _roles(md: Column, flexible: bool) -> Column:
    pattern = r"<!-- role:(\w+)(?: .*?)? -->" if flexible else r"<!-- role:(\w+)(?:\s+([^>]+))? -->"
    return F.regexp_extract_all(md, F.lit(pattern), F.lit(1))


def annotations(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, page_count_found, role_count, pages_in_order, invalid_roles) by the stricter whitelist."""
    text = F.col(md)
    pages = numbers_of(text, "page")
    own = _roles(text, False)
    return df.select(key, F.size(pages).alias("page_markers"), F.size(own).alias("role_count"), in_sequence(pages).alias("pages_in_order"), F.array_join(F.array_sort(F.array_except(own, F.array(*[F.lit(r) for r in LLM_ROLES]))), ",").alias("invalid_roles"))


def invalid_roles(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, llm_invalid, ocr_invalid): roles outside each validator's list."""
    text = F.col(md)
    outside = lambda own, known: F.array_join(F.array_sort(F.array_except(own, F.array(*[F.lit(r) for r in known]))), ",")
    return df.select(key, outside(_roles(text, False), LLM_ROLES).alias("llm_invalid"), outside(_roles(text, True), OCR_ROLES).alias("ocr_invalid"))


def role_distribution(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    return df.select(key, F.explode(_roles(F.col(md), True)).alias("role")).groupBy(key, "role").agg(F.count("*").alias("n"))


def reading_order_check(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, order_count, in_order): reading-order markers over the whole text must be 1, 2, ..."""
    order = numbers_of(F.col(md), "reading-order")
    return df.select(key, F.size(order).alias("order_count"), in_sequence(order).alias("in_order"))


def completeness(df: DataFrame, key: str, pages: Column, expected: Column | None = None, md: str = "md") -> DataFrame:
    """(key, word_count, expected_min, expected_max, score, verdict): words beside comments against 150 to 600 a page, or 0.8 to 1.5 of an expected number."""
    text = strip_comments(F.col(md))
    n = F.size(words(text))
    given = F.coalesce(expected, F.lit(0)) if expected is not None else F.lit(0)
    low = F.when(given > 0, F.floor(given * 0.8)).otherwise(pages * 150).cast("long")
    high = F.when(given > 0, F.floor(given * 1.5)).otherwise(pages * 600).cast("long")
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""))
    rows = df.select(key, n.alias("word_count"), lines.alias("line_count"), low.alias("expected_min"), high.alias("expected_max"))
    score = F.when(F.col("word_count") < F.col("expected_min"), F.col("word_count") / F.col("expected_min")).otherwise(1.0)
    verdict = F.when(F.col("word_count") < F.col("expected_min"), "possibly_incomplete").when(F.col("word_count") > F.col("expected_max"), "possibly_excessive").otherwise("ok")
    return rows.select("*", F.round(score, 6).alias("score"), verdict.alias("verdict"))


def llm_scores(df: DataFrame, key: str, method: Column, pages: Column) -> DataFrame:
    """(key, quality_score, base_quality_score, hallucination_count) of a model's output."""
    joined = base_report(df, key, method).join(annotations(df, key), key).join(completeness(df, key, pages).select(key, F.col("score").alias("whole")), key)
    talk = commentary_matches(df, key).groupBy(key).agg(F.count("*").alias("t"))
    rows = joined.join(talk, key, "left").withColumn("t", F.coalesce("t", F.lit(0)))
    off = F.col("t") * 0.1 + F.when(F.col("page_markers") == 0, 0.15).otherwise(0.0) + F.when(F.col("role_count") == 0, 0.15).otherwise(0.0) + (1.0 - F.col("whole")) * 0.2
    return rows.select(key, F.round(F.greatest(F.lit(0.0), F.col("quality_score") - off), 6).alias("quality_score"), F.col("quality_score").alias("base_quality_score"), F.col("t").alias("hallucination_count"))


def layout_check(df: DataFrame, key: str, md: str = "md", expected_columns: int | None = None) -> DataFrame:
    """(key, page_count_found, order_count, order_ok, detected_columns, column_mismatch): columns by markers a page, over 20 and over 40."""
    text = F.col(md)
    pages, order = F.size(numbers_of(text, "page")), numbers_of(text, "reading-order")
    each = F.size(order) / pages
    columns = F.when((F.size(order) > 0) & (pages > 0), F.when(each > 40, 3).when(each > 20, 2).otherwise(1)).otherwise(1)
    wrong = columns != F.lit(expected_columns) if expected_columns else F.lit(False)
    return df.select(key, pages.alias("page_markers"), F.size(order).alias("order_count"), in_sequence(order).alias("order_ok"), columns.alias("detected_columns"), wrong.alias("column_mismatch"))


def confidence_markers(df: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, low_confidence_count, avg_low_confidence, min_confidence, uncertain_count, uncertain_percentage) from markers in the text."""
    text = F.col(md)
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"<!-- confidence:(0\.\d+) -->"), F.lit(1)), lambda x: x.cast("double"))
    total = F.aggregate(marks, F.lit(0.0), lambda a, b: a + b)
    unsure = _count(text, r"\[uncertain: .*?\]")
    rows = df.select(key, F.size(marks).alias("low_confidence_count"), F.when(F.size(marks) > 0, F.round(total / F.size(marks), 6)).alias("avg_low_confidence"), F.array_min(marks).alias("min_confidence"), unsure.alias("uncertain_count"), F.size(F.split(md, "\n")).alias("__lines"))
    return rows.select(key, "low_confidence_count", "avg_low_confidence", "min_confidence", "uncertain_count", F.round(F.col("uncertain_count") / F.col("__lines") * 100, 6).alias("uncertain_percentage"))


def ocr_scores(df: DataFrame, key: str, method: Column, pages: Column) -> DataFrame:
    """(key, quality_score, base_quality_score) of recognised text."""
    joined = (
        base_report(df, key, method)
        .join(layout_check(df, key), key)
        .join(annotations(df, key).select(key, "role_count"), key)
        .join(confidence_markers(df, key), key)
        .join(completeness(df, key, pages).select(key, F.col("score").alias("whole")), key)
    )
    off = (
        F.when(F.col("page_markers") == 0, 0.15).otherwise(0.0)
        + F.when(F.col("role_count") == 0, 0.10).otherwise(0.0)
        + F.when(F.col("uncertain_percentage") > 20, 0.15).otherwise(0.0)
        + (1.0 - F.col("whole")) * 0.20
        + F.when(F.col("order_ok"), 0.0).otherwise(0.10)
    )
    return joined.select(key, F.round(F.greatest(F.lit(0.0), F.col("quality_score") - off), 6).alias("quality_score"), F.col("quality_score").alias("base_quality_score"))


def output_issues(df: DataFrame, key: str, pages: Column) -> DataFrame:
    """(key, validator, type, line): every issue of the validators of model output, in one table."""
    talk = commentary_matches(df, key).select(key, F.lit("llm").alias("validator"), F.lit("hallucination").alias("type"), "line")
    marks = annotations(df, key)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("page_markers") == 0, F.lit("missing_page_markers")),
            F.when(~F.col("pages_in_order"), F.lit("non_sequential_pages")),
            F.when(F.col("role_count") == 0, F.lit("missing_role_annotations")),
            F.when(F.col("invalid_roles") != "", F.lit("invalid_role_types")),
        )
    )
    roles = marks.select(key, F.lit("annotations").alias("validator"), F.explode(kinds).alias("type"))
    order = reading_order_check(df, key).filter("not in_order").select(key, F.lit("reading_order").alias("validator"), F.lit("non_sequential_order").alias("type"))
    whole = completeness(df, key, pages).filter("verdict <> 'ok'").select(key, F.lit("completeness").alias("validator"), F.col("verdict").alias("type"))
    base = syntax(df, key).select(key, F.lit("syntax").alias("validator"), F.explode(F.concat(F.array_repeat(F.lit("empty_link"), F.col("empty_links").cast("int")), F.when(F.col("unclosed_code"), F.array(F.lit("unclosed_code_block"))).otherwise(F.array().cast("array<string>")))).alias("type"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [talk, roles, order, whole, base])
