"""Queries that validate and score Markdown, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.operators import validate as V
from folioscope.plans.sql import any_of, over_markdown, strip, words
from folioscope.plans.text_queries import CLOSE, COMMENTS, FLEX, HAS, NUMS, POINTS, SEQ, VIEW
from folioscope.sources.elements import markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = "doc_id"


def on_markdown(name: str, run: Callable[[DataFrame], DataFrame], select: str | None = None, more: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: run(markdown(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    if select is not None:
        SQL[name] = over_markdown(select, more)


def count(pattern: str) -> str:
    return f"len(regexp_extract_all(md, '{pattern}'))"


BLOCK = f"md[4:2 + {CLOSE}]"
MISSING = f"list_filter(range(1, list_max({FLEX}) + 1), lambda x: NOT list_contains({FLEX}, x))"
ROLES, HEADS, BARS = count(r"<!--\s*role:\w+"), count(r"(?m)^#{1,6}\s+"), f"({count(r'(?m)^\|')} // 2)"


def lacks(word: str) -> str:
    return f"{HAS} AND {CLOSE} > 0 AND NOT contains({BLOCK}, '{word}')"


def unnested(checks: list[tuple[str, str, str, str]]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {{'s': '{s}', 'c': '{k}', 'm': {m}}} END" for c, s, k, m in checks)
    return f"SELECT doc_id, i.s AS severity, i.c AS category, i.m AS message FROM (SELECT doc_id, unnest([{items}]) AS i FROM md) WHERE i IS NOT NULL"


SCHEMA = unnested(
    [
        (f"NOT {HAS}", "error", "schema", "'Missing YAML frontmatter'"),
        (f"{HAS} AND {CLOSE} = 0", "error", "schema", "'Incomplete YAML frontmatter (missing closing ---)'"),
        (lacks("document:"), "error", "schema", "'Missing document section in frontmatter'"),
        (lacks("source_file:"), "warning", "schema", "'Missing source_file in frontmatter'"),
        (lacks("quality:"), "warning", "schema", "'Missing quality section in frontmatter'"),
        (f"len({FLEX}) = 0", "warning", "schema", "'No page markers found'"),
        (f"len({FLEX}) > 0 AND len({MISSING}) > 0", "warning", "schema", f"'Missing page markers: [' || array_to_string({MISSING}, ', ') || ']'"),
        (f"{ROLES} < ({HEADS} + {BARS}) * 0.5e0", "warning", "schema", f"'Low annotation coverage: ' || {ROLES} || ' annotations for ' || {HEADS} || ' headings and ' || {BARS} || ' tables'"),
    ]
)
AFTER = f"CASE WHEN starts_with(md, '---') AND {CLOSE} > 0 AND instr(md[{CLOSE} + 3:], chr(10)) > 0 THEN md[{CLOSE} + 2 + instr(md[{CLOSE} + 3:], chr(10)) + 1:] ELSE md END"
NLINES = f"len(list_filter(string_split({AFTER}, chr(10)), lambda x: {strip('x')} <> '' AND NOT starts_with({strip('x')}, '<!--')))"
UNSURE, LOW = count(r"\[uncertain:"), count(r"\[low-confidence:")
FIRST = r"length(regexp_extract(md, '(?m)^(#{1,6})\s+', 1))"
CONTENT = unnested(
    [
        (f"{NLINES} < 3", "error", "content", "'Document appears to have very little content'"),
        (f"{UNSURE} > {NLINES} * 0.3e0", "warning", "content", f"'High uncertainty: ' || {UNSURE} || ' uncertain regions'"),
        (f"{LOW} > {NLINES} * 0.1e0", "warning", "content", f"'Many low-confidence regions: ' || {LOW}"),
        (f"{FIRST} > 1", "info", "content", f"'Document does not start with H1 (starts with H' || {FIRST} || ')'"),
    ]
)
TALK = f"SELECT doc_id, line_no + 1 AS line, line[1:80] AS context FROM lv WHERE {any_of('line', P.COMMENTARY_FRAMEWORK, '(?i)')}"
S = strip("line")
FORMAT = f"""SELECT doc_id, 'info' AS severity, 'format' AS category, 'Very long line (' || length(line) || ' chars)' AS message, line_no + 1 AS line FROM lv WHERE length(line) > 500 AND NOT starts_with(line, '|')
UNION ALL SELECT doc_id, 'warning', 'format', 'Incomplete table row', line_no + 1 FROM lv WHERE starts_with({S}, '|') AND NOT ends_with({S}, '|')"""
ISSUES = f"iss AS (SELECT *, NULL::BIGINT AS line FROM ({SCHEMA}) UNION ALL SELECT *, NULL FROM ({CONTENT}) UNION ALL SELECT doc_id, 'error', 'hallucination', 'Potential hallucination detected', line FROM ({TALK}) UNION ALL SELECT * FROM ({FORMAT}))"
REPORT = """rep AS (SELECT doc_id, true AS is_valid, round(greatest(0e0, least(1e0, 1e0 - coalesce(errors, 0) * 0.15e0 - coalesce(warnings, 0) * 0.05e0 - coalesce(infos, 0) * 0.01e0))::DECIMAL(18, 9), 4)::DOUBLE AS quality_score, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos,
  coalesce(h, 0) AS hallucination_count, coalesce(sc, 0) AS schema_issues, coalesce(co, 0) AS content_issues, coalesce(fo, 0) AS format_issues, coalesce(h, 0) > 0 AS hallucination_detected
  FROM md LEFT JOIN (SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (category = 'hallucination') AS h, count(*) FILTER (category = 'schema') AS sc,
  count(*) FILTER (category = 'content') AS co, count(*) FILTER (category = 'format') AS fo FROM iss GROUP BY 1) USING (doc_id))"""
on_markdown("validate_schema", lambda m: V.schema_issues(m, K), SCHEMA)
on_markdown("validate_content", lambda m: V.content_issues(m, K), CONTENT)
on_markdown("hallucination_framework", lambda m: V.commentary_lines(m, K), TALK, VIEW)
on_markdown("validate_format", lambda m: V.format_issues(m, K), FORMAT, VIEW)
on_markdown("issue_summary", lambda m: V.issue_summary(V.issues(m, K), K), "SELECT doc_id, severity, category, count(*) AS n FROM iss GROUP BY ALL", f"{VIEW}, {ISSUES}")
on_markdown("validation_report", lambda m: V.report(m, K), "SELECT * FROM rep", f"{VIEW}, {ISSUES}, {REPORT}")
GATE = f"""ga AS (SELECT *, (quality_score < 0.6e0)::INT + (hallucination_count > 0)::INT + (errors > 2)::INT + (content_lines < 5)::INT AS n_failures FROM rep JOIN
  (SELECT doc_id, count(*) FILTER ({S} <> '' AND NOT starts_with(line, '---') AND NOT starts_with(line, '<!--')) AS content_lines FROM lv GROUP BY 1) USING (doc_id)),
gb AS (SELECT doc_id, n_failures = 0 AS passed, n_failures, content_lines, CASE WHEN quality_score >= 0.9e0 THEN 'excellent' WHEN quality_score >= 0.8e0 THEN 'good' WHEN quality_score >= 0.6e0 THEN 'acceptable' WHEN quality_score >= 0.4e0 THEN 'poor' ELSE 'unacceptable' END AS quality_level,
  CASE WHEN n_failures = 0 THEN 'accept' WHEN hallucination_count > 0 THEN 'fallback_to_local_ocr' WHEN quality_score < 0.3e0 THEN 'reject_and_retry' WHEN quality_score < 0.5e0 THEN 'fallback_to_alternative' ELSE 'accept_with_warnings' END AS suggested_action FROM ga)"""
ALL = f"{VIEW}, {ISSUES}, {REPORT}, {GATE}"
on_markdown("quality_gate", lambda m: V.gate(m, V.report(m, K), K), "SELECT * FROM gb", ALL)
on_markdown("quality_level", lambda m: V.gate(m, V.report(m, K), K).select(K, "quality_level"), "SELECT doc_id, quality_level FROM gb", ALL)
on_markdown("suggested_action", lambda m: V.gate(m, V.report(m, K), K).groupBy("suggested_action").agg(F.count("*").alias("n")), "SELECT suggested_action, count(*) AS n FROM gb GROUP BY 1", ALL)

# The base validator.
SYNTAX = rf"""sy AS (SELECT doc_id, empty_links = 0 AND NOT unclosed_code AS syntax_valid, empty_links, unclosed_code, unmatched_brackets FROM (SELECT doc_id,
  list_sum(list_transform(string_split(md, chr(10)), lambda x: len(regexp_extract_all(x, '\[([^\]]+)\]\(\)'))))::BIGINT AS empty_links, {count('```')} % 2 <> 0 AS unclosed_code,
  len(list_filter(string_split(md, chr(10)), lambda x: length(replace(x, '[', '')) <> length(replace(x, ']', '')))) AS unmatched_brackets FROM md))"""
COMPLIANCE = rf"""cm AS (SELECT doc_id, {HAS} AND {CLOSE} > 0 AS compliant, {HAS} AND {CLOSE} = 0 AS malformed, (NOT {HAS})::INT + ({lacks('document:')})::INT + ({lacks('source_file:')})::INT + ({lacks('document_id:')})::INT + (NOT regexp_matches(md, '<!-- role:\w+ -->'))::INT AS missing_warnings,
  regexp_matches(md, '<!-- role:\w+ -->') AS has_annotations FROM md)"""
on_markdown("validate_syntax", lambda m: V.syntax(m, K), "SELECT * FROM sy", SYNTAX)
on_markdown("schema_compliance", lambda m: V.compliance(m, K), "SELECT * FROM cm", COMPLIANCE)
MARKS = "mk AS (SELECT doc_id, line_no + 1 AS line, x AS pattern, " + S + " AS text FROM (SELECT *, unnest([" + ", ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN '{p}' END" for p in P.COMMENTARY_BASE) + "]) AS x FROM lv) WHERE x IS NOT NULL)"
on_markdown("hallucination_base", lambda m: V.commentary_patterns(m, K), "SELECT * FROM mk", f"{VIEW}, {MARKS}")
SCORE = rf"""least(1e0, (CASE WHEN syntax_valid THEN 30 ELSE greatest(0, 30 - (empty_links + unclosed_code::INT) * 5) END + CASE WHEN compliant THEN 20 ELSE greatest(0, 20 - missing_warnings * TIMES * 5) END
  + CASE WHEN regexp_matches(md, '(?m)^#{{1,6}}\s') THEN 5 ELSE 0 END + CASE WHEN contains(md, '|') AND contains(md, '---') THEN 7 ELSE 0 END + CASE WHEN regexp_matches(md, '(?m)^[\-*+]\s') THEN 4 ELSE 0 END + CASE WHEN contains(md, '*') THEN 4 ELSE 0 END + {POINTS} + SURE) / 100e0)"""
BASE = f"""{VIEW}, {SYNTAX}, {COMPLIANCE}, {MARKS}, ba AS (SELECT md.*, sy.* EXCLUDE (doc_id), cm.* EXCLUDE (doc_id), round({SCORE.replace('TIMES', '2').replace('SURE', '5e0')}, 6) AS base FROM md JOIN sy USING (doc_id) JOIN cm USING (doc_id))"""
on_markdown("quality_score", lambda m: V.base_scores(m, K, F.col("method"), (F.col("doc_id") % 11) / 10), f"SELECT doc_id, round({SCORE.replace('TIMES', '1').replace('SURE', '(doc_id % 11) / 10e0 * 10')}, 6) AS quality_score FROM md JOIN sy USING (doc_id) JOIN cm USING (doc_id)", f"{SYNTAX}, {COMPLIANCE}")
on_markdown(
    "base_validation_report",
    lambda m: V.base_report(m, K, F.col("method")),
    f"""SELECT doc_id, base AS quality_score, syntax_valid, compliant AS schema_compliant, empty_links + unclosed_code::INT + malformed::INT AS n_issues, (missing_warnings + unmatched_brackets) * 2 AS n_warnings, coalesce(n, 0) AS n_markers, len({words('md')}) AS word_count, len(string_split(md, chr(10))) AS line_count
FROM ba LEFT JOIN (SELECT doc_id, count(*) AS n FROM mk GROUP BY 1) USING (doc_id)""",
    BASE,
)

# Model output.
TYPED = "ty AS (SELECT doc_id, line_no + 1 AS line, x.k AS subtype, x.p AS matched_phrase FROM (SELECT *, unnest(list_concat(" + ", ".join(f"list_transform(regexp_extract_all(line, '(?i){p}'), lambda q: {{'k': '{k}', 'p': q}})" for p, k in P.COMMENTARY_TYPED) + f")) AS x FROM lv WHERE NOT starts_with({S}, '<!--')))"
on_markdown("hallucination_llm", lambda m: V.commentary_matches(m, K), "SELECT * FROM ty", f"{VIEW}, {TYPED}")
STRICT = r"regexp_extract_all(md, '<!-- role:(\w+)(?:\s+([^>]+))? -->', 1)"
LOOSE = r"regexp_extract_all(md, '<!-- role:(\w+)(?: .*?)? -->', 1)"


def outside(own: str, known: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in known)
    return f"coalesce(array_to_string(list_sort(list_distinct(list_filter({own}, lambda r: r NOT IN ({listed})))), ','), '')"


MARKERS = f"an AS (SELECT doc_id, len({NUMS.format('page')}) AS page_markers, len({STRICT}) AS role_count, {SEQ.format(NUMS.format('page'))} AS pages_in_order, {outside(STRICT, P.LLM_ROLES)} AS invalid_roles FROM md)"
on_markdown("validate_annotations", lambda m: V.annotations(m, K), "SELECT * FROM an", MARKERS)
on_markdown("invalid_roles", lambda m: V.invalid_roles(m, K), f"SELECT doc_id, {outside(STRICT, P.LLM_ROLES)} AS llm_invalid, {outside(LOOSE, P.OCR_ROLES)} AS ocr_invalid FROM md")
on_markdown("role_distribution", lambda m: V.role_distribution(m, K), f"SELECT doc_id, role, count(*) AS n FROM (SELECT doc_id, unnest({LOOSE}) AS role FROM md) GROUP BY 1, 2")
ORDER = f"rd AS (SELECT doc_id, len({NUMS.format('reading-order')}) AS order_count, {SEQ.format(NUMS.format('reading-order'))} AS in_order FROM md)"
on_markdown("validate_reading_order", lambda m: V.reading_order_check(m, K), "SELECT * FROM rd", ORDER)


def completeness(expected: str) -> str:
    text = COMMENTS.format("md")
    return f"""(SELECT doc_id, word_count, line_count, lo AS expected_min, hi AS expected_max, round(CASE WHEN word_count < lo THEN word_count * 1e0 / lo ELSE 1e0 END, 6) AS score, CASE WHEN word_count < lo THEN 'possibly_incomplete' WHEN word_count > hi THEN 'possibly_excessive' ELSE 'ok' END AS verdict
  FROM (SELECT doc_id, len({words(text)}) AS word_count, len(list_filter(string_split({text}, chr(10)), lambda x: {strip('x')} <> '')) AS line_count, CASE WHEN ex > 0 THEN floor(ex * 0.8e0) ELSE page_count * 150 END::BIGINT AS lo, CASE WHEN ex > 0 THEN floor(ex * 1.5e0) ELSE page_count * 600 END::BIGINT AS hi FROM (SELECT *, {expected} AS ex FROM md)))"""


WHOLE = f"wh AS {completeness('0')}"
on_markdown("completeness", lambda m: V.completeness(m, K, F.col("page_count"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 700)), f"SELECT * FROM {completeness('CASE WHEN doc_id % 2 = 0 THEN doc_id % 700 ELSE 0 END')}")
on_markdown(
    "validate_llm_output",
    lambda m: V.llm_scores(m, K, F.col("method"), F.col("page_count")),
    """SELECT doc_id, round(greatest(0e0, base - (coalesce(t, 0) * 0.1e0 + CASE WHEN page_markers = 0 THEN 0.15e0 ELSE 0e0 END + CASE WHEN role_count = 0 THEN 0.15e0 ELSE 0e0 END + (1e0 - score) * 0.2e0)), 6) AS quality_score, base AS base_quality_score, coalesce(t, 0) AS hallucination_count
FROM ba JOIN an USING (doc_id) JOIN wh USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS t FROM ty GROUP BY 1) USING (doc_id)""",
    f"{BASE}, {TYPED}, {MARKERS}, {WHOLE}",
)
on_markdown(
    "issues_union",
    lambda m: V.output_issues(m, K, F.col("page_count")).groupBy(K, "validator", "type").agg(F.count("*").alias("n"), F.count("line").alias("lines")),
    """SELECT doc_id, validator, type, count(*) AS n, count(line) AS lines FROM (SELECT doc_id, 'llm' AS validator, 'hallucination' AS type, line FROM ty
  UNION ALL SELECT doc_id, 'annotations', 'missing_page_markers', NULL FROM an WHERE page_markers = 0 UNION ALL SELECT doc_id, 'annotations', 'non_sequential_pages', NULL FROM an WHERE NOT pages_in_order
  UNION ALL SELECT doc_id, 'annotations', 'missing_role_annotations', NULL FROM an WHERE role_count = 0 UNION ALL SELECT doc_id, 'annotations', 'invalid_role_types', NULL FROM an WHERE invalid_roles <> ''
  UNION ALL SELECT doc_id, 'reading_order', 'non_sequential_order', NULL FROM rd WHERE NOT in_order UNION ALL SELECT doc_id, 'completeness', verdict, NULL FROM wh WHERE verdict <> 'ok'
  UNION ALL SELECT doc_id, 'syntax', unnest(list_transform(range(empty_links), lambda x: 'empty_link')), NULL FROM sy UNION ALL SELECT doc_id, 'syntax', 'unclosed_code_block', NULL FROM sy WHERE unclosed_code) GROUP BY 1, 2, 3""",
    f"{VIEW}, {SYNTAX}, {TYPED}, {MARKERS}, {ORDER}, {WHOLE}",
)

# Recognised text.
ORDERS, PAGES = f"len({NUMS.format('reading-order')})", f"len({NUMS.format('page')})"
COLUMNS = f"CASE WHEN {ORDERS} > 0 AND {PAGES} > 0 THEN CASE WHEN {ORDERS} * 1e0 / {PAGES} > 40 THEN 3 WHEN {ORDERS} * 1e0 / {PAGES} > 20 THEN 2 ELSE 1 END ELSE 1 END"
LAYOUT = f"ly AS (SELECT doc_id, {PAGES} AS page_markers, {ORDERS} AS order_count, {SEQ.format(NUMS.format('reading-order'))} AS order_ok, {COLUMNS} AS detected_columns, {COLUMNS} <> 2 AS column_mismatch FROM md)"
on_markdown("validate_layout", lambda m: V.layout_check(m, K, expected_columns=2), "SELECT * FROM ly", LAYOUT)
on_markdown("column_estimate", lambda m: V.layout_check(m, K).select(K, "order_count", "detected_columns"), "SELECT doc_id, order_count, detected_columns FROM ly", LAYOUT)
SURE = r"list_transform(regexp_extract_all(md, '<!-- confidence:(0\.\d+) -->', 1), lambda x: x::DOUBLE)"
CONF = f"""cf AS (SELECT doc_id, len({SURE}) AS low_confidence_count, round(list_sum({SURE}) / len({SURE}), 6) AS avg_low_confidence, list_min({SURE}) AS min_confidence, {count(r'\[uncertain: .*?\]')} AS uncertain_count,
  round({count(r'\[uncertain: .*?\]')} * 1e0 / len(string_split(md, chr(10))) * 100, 6) AS uncertain_percentage FROM md)"""
on_markdown("confidence_markers", lambda m: V.confidence_markers(m, K), "SELECT * FROM cf", CONF)
on_markdown(
    "validate_ocr_output",
    lambda m: V.ocr_scores(m, K, F.col("method"), F.col("page_count")),
    """SELECT doc_id, round(greatest(0e0, base - (CASE WHEN ly.page_markers = 0 THEN 0.15e0 ELSE 0e0 END + CASE WHEN role_count = 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN uncertain_percentage > 20 THEN 0.15e0 ELSE 0e0 END + (1e0 - score) * 0.2e0 + CASE WHEN order_ok THEN 0e0 ELSE 0.1e0 END)), 6) AS quality_score, base AS base_quality_score
FROM ba JOIN an USING (doc_id) JOIN wh USING (doc_id) JOIN ly USING (doc_id) JOIN cf USING (doc_id)""",
    f"{BASE}, {MARKERS}, {WHOLE}, {LAYOUT}, {CONF}",
)
