"""Queries over texts, Markdown, web pages and state tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.functions import text as T
from folioscope.functions.patterns import DISPLAY_POINTS, METHOD_POINTS, TIERS
from folioscope.operators import enforce as E
from folioscope.operators import export as X
from folioscope.operators import state as ST
from folioscope.plans.sql import over_markdown, strip, words
from folioscope.sources.elements import html_blocks, markdown
from folioscope.streaming.documents import usage_sessions, usage_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_docs(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(_table(spark, sf_dir, "documents"))
    if sql is not None:
        SQL[name] = sql


def on_markdown(name: str, run: Callable[[DataFrame], DataFrame], select: str | None = None, more: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: run(markdown(_table(spark, sf_dir, "documents")))
    if select is not None:
        SQL[name] = over_markdown(select, more)


#: A text with everything that the clean-up functions look for; the same expression in both engines.
MESSY = "'  − a – b' || chr(10) || '   * item ' || text || chr(10) || chr(10) || chr(10) || chr(10) || '# Head bro-' || chr(10) || 'ken and Ab1-' || chr(10) || ' Cd2' || chr(10) || '|=- stray  two   blanks' || chr(10) || '<!-- role:artifact --> <!-- /role -->' || chr(10) || '## Page 12' || chr(10) || '**bold** and *it* with `code` see [link](http://x) 2024-01-05 ' || text || chr(10) || '  '"


def scalar(name: str, column: Callable[[], object], sql: str) -> None:
    """A function of the messy text of each document, which has the whole text twice."""
    on_docs(name, lambda d: d.selectExpr("doc_id", f"{MESSY} AS t").select("doc_id", column().alias("out")), f"SELECT doc_id, {sql} AS out FROM (SELECT doc_id, {MESSY} AS t FROM documents)")


t = lambda: F.col("t")
HYPHEN_STRICT = r"regexp_replace({0}, '([a-zA-Z]+)-\s*\n\s*([a-z]+)', '\1\2', 'g')"
scalar("hyphen_merge_strict", lambda: T.merge_hyphens(t()), HYPHEN_STRICT.format("t"))
scalar("hyphen_merge_loose", lambda: T.merge_hyphens(t(), strict=False), r"regexp_replace(t, '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g')")
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[|_\-=+]+\s*', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n\s*\n{2,}', chr(10) || chr(10), 'g')"
scalar("clean_artifacts", lambda: T.clean_artifacts(t()), strip(CLEAN))
NORMAL = r"regexp_replace(translate(t, '−–—―', '----'), '(?m)(^|\n\n)[ ]{2,4}([-*+])\s', '\1\2 ', 'g')"
NORMAL = rf"regexp_replace({NORMAL}, '\n{{3,}}', chr(10) || chr(10), 'g')"
NORMAL = rf"regexp_replace({NORMAL}, '(?m)^(\s*)\* ', '\1- ', 'g')"
NORMAL = rf"regexp_replace({NORMAL}, '([^\n])\n(#{{1,6}} )', '\1' || chr(10) || chr(10) || '\2', 'g')"
NORMAL = rf"regexp_replace({NORMAL}, '<!-- role:\w+ -->\s*<!-- /role -->', '', 'g')"
scalar("normalize_markdown", lambda: T.normalize_markdown(t()), strip(NORMAL))
COMMENTS = "regexp_replace({0}, '(?s)<!--.*?-->', '', 'g')"
scalar("strip_comments", lambda: T.strip_comments(t()), COMMENTS.format("t"))
PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '#{{1,6}}\s', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g')"
LINKS = r"regexp_replace({0}, '\[(.+?)\]\(.+?\)', '\1', 'g')"
scalar("md_to_txt", lambda: T.markdown_to_text(t()), LINKS.format(PLAIN.format("t")))
scalar("md_to_txt_code", lambda: T.markdown_to_text(t(), code=True), LINKS.format(rf"regexp_replace({PLAIN.format('t')}, '`(.+?)`', '\1', 'g')"))
SAFE = r"""regexp_replace({0}, '[<>:"/\\|?*]', '_', 'g')"""
SAFE = rf"regexp_replace(regexp_replace(replace({SAFE}, '$', 'USD'), '[() ,]', '_', 'g'), '_+', '_', 'g')"
SAFE = f"regexp_replace({SAFE}, '^_|_$', '', 'g')[1:200]"
scalar("sanitize_filename", lambda: T.safe_file_name(F.concat(F.lit("a$b (x), y<z>: "), t())), SAFE.format("'a$b (x), y<z>: ' || t"))
scalar("fold_case", lambda: T.fold_case(t()), rf"regexp_replace(lower({strip('t')}), '\s+', ' ', 'g')")
ENDS = r"regexp_replace(regexp_replace(regexp_replace({0}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\r\n?', chr(10), 'g'), '(?m)[ \t\r\f\v]+$', '', 'g')"
ENDS = rf"regexp_replace({ENDS}, '\n+$', '') || chr(10)"
on_markdown("cleanup_formatting", lambda m: m.select("doc_id", T.clean_ends(F.col("md")).alias("out")), rf"SELECT doc_id, {ENDS.format('md')} AS out FROM md")

on_docs("count_stats", lambda d: d.select("doc_id", F.size(T.words(F.col("text"))).alias("words"), F.length("text").alias("chars")), f"SELECT doc_id, len({words('text')}) AS words, length(text) AS chars FROM documents")
on_docs(
    "route_digital_vs_scan",
    lambda d: d.select("doc_id", F.when((F.length(T.strip(F.col("text"))) > 100) & (F.size(T.words(F.col("text"))) > 100), "digital").otherwise("ocr").alias("route")),
    f"SELECT doc_id, CASE WHEN length({strip('text')}) > 100 AND len({words('text')}) > 100 THEN 'digital' ELSE 'ocr' END AS route FROM documents",
)
on_docs(
    "doc_metadata",
    lambda d: d.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.size(T.words(F.col("text")))).alias("text_layer_word_count"), F.sum(F.octet_length("text")).alias("file_size_bytes")).withColumn("document_id", S.document_id(F.col("source"))),
    f"SELECT source, count(*) AS pages, sum(len({words('text')}))::BIGINT AS text_layer_word_count, sum(strlen(text))::BIGINT AS file_size_bytes, sha256(source)[1:16] AS document_id FROM documents GROUP BY 1",
)
on_docs("document_id", lambda d: d.select("doc_id", S.document_id(F.col("text")).alias("document_id")), "SELECT doc_id, sha256(text)[1:16] AS document_id FROM documents")
on_docs("file_hash", lambda d: d.select("doc_id", F.md5("text").alias("file_hash")), "SELECT doc_id, md5(text) AS file_hash FROM documents")
VOCAB = r"[\p{L}\p{N}_]+"
on_docs(
    "vocab_size",
    lambda d: d.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(VOCAB), F.lit(0)))).alias("w")).groupBy("lang").agg(F.countDistinct("w").alias("n")),
    f"SELECT lang, count(DISTINCT w) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{VOCAB}')) AS w FROM documents) GROUP BY 1",
)
on_docs("vocab_size_approx", lambda d: d.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(VOCAB), F.lit(0)))).alias("w")).groupBy("lang").agg(F.approx_count_distinct("w", 0.02).alias("n")))
DATE = "CASE doc_id % 6 WHEN 0 THEN 'D:20240115120000' WHEN 1 THEN 'D:202401' || cast(10 + doc_id % 20 AS STRING) WHEN 2 THEN '20231231235959' WHEN 3 THEN '' WHEN 4 THEN 'invalid' ELSE 'D:2019' END"
on_docs(
    "parse_pdf_date",
    lambda d: d.select("doc_id", S.pdf_date(F.expr(DATE)).alias("iso")),
    f"""SELECT doc_id, CASE WHEN length(s) >= 4 AND regexp_matches(s[1:4], '^\\d{{4}}$') THEN s[1:4] || '-' || CASE WHEN length(s) >= 6 THEN s[5:6] ELSE '01' END || '-' || CASE WHEN length(s) >= 8 THEN s[7:8] ELSE '01' END || 'T'
  || CASE WHEN length(s) >= 10 THEN s[9:10] ELSE '00' END || ':' || CASE WHEN length(s) >= 12 THEN s[11:12] ELSE '00' END || ':' || CASE WHEN length(s) >= 14 THEN s[13:14] ELSE '00' END ELSE '' END AS iso
FROM (SELECT doc_id, regexp_replace({DATE}, '^D:', '') AS s FROM documents)""",
)
LABEL = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{x[1]}'" for k, x in enumerate(TIERS)) + " ELSE 'unknown' END"
RATE = {k: "CASE label " + " ".join(f"WHEN '{x[1]}' THEN {x[k]!r}::DOUBLE" for x in TIERS) + " ELSE 0e0 END" for k in (2, 3)}
on_docs("model_tier_lookup", lambda d: d.select("doc_id", S.tier_of(F.expr(LABEL)).alias("tier")), f"SELECT doc_id, CASE label {' '.join(f"WHEN '{x[1]}' THEN '{x[0]}'" for x in TIERS)} ELSE 'free' END AS tier FROM (SELECT doc_id, {LABEL} AS label FROM documents)")
on_docs(
    "cost_per_page",
    lambda d: d.select("doc_id", S.cost_by_pages(F.expr(LABEL), F.col("doc_id") % 700).alias("cost")),
    f"SELECT doc_id, '**Estimated Cost:** ' || CASE WHEN c = 0 THEN 'FREE' WHEN c < 0.01e0 THEN '< $0.01' ELSE '$' || printf('%.2f', c) END AS cost FROM (SELECT doc_id, (doc_id % 700) / 1000e0 * {RATE[2]} AS c FROM (SELECT doc_id, {LABEL} AS label FROM documents))",
)
on_docs(
    "cost_tokens",
    lambda d: d.select("doc_id", S.cost_by_tokens(F.expr(LABEL), F.col("doc_id") * 1000 + 1).alias("cost")),
    f"""SELECT doc_id, CASE WHEN c = 0 THEN '**Estimated Cost:** FREE' ELSE '**Estimated Cost:** ~$' || CASE WHEN c < 0.01e0 THEN printf('%.4f', c) ELSE printf('%.2f', c) END || ' (' || p || CASE WHEN p > 1 THEN ' pages)' ELSE ' page)' END END AS cost
FROM (SELECT doc_id, p, p * 1000 / 1000000e0 * {RATE[3]} AS c FROM (SELECT doc_id, doc_id * 1000 + 1 AS p, {LABEL} AS label FROM documents))""",
)
POINTS = "CASE " + " ".join(f"WHEN contains(method, '{n}') THEN {p}" for n, p in METHOD_POINTS) + " ELSE 10 END"
BONUS = "CASE " + " ".join(f"WHEN contains(method, '{n}') THEN {p}" for n, p in DISPLAY_POINTS) + " ELSE 0 END"
on_markdown("method_score", lambda m: m.select("doc_id", S.method_points(F.col("method")).alias("points")), f"SELECT doc_id, {POINTS} AS points FROM md")
on_markdown(
    "ui_quality_score",
    lambda m: m.select("doc_id", S.display_score(F.col("md"), F.col("method")).alias("score")),
    f"SELECT doc_id, least(100, 50 + {BONUS} + CASE WHEN contains(md, '##') THEN 10 ELSE 0 END + CASE WHEN contains(md, '|') THEN 10 ELSE 0 END + CASE WHEN length(md) > 1000 THEN 10 ELSE 0 END) AS score FROM md",
)

# Markdown as lines and blocks.
VIEW = "lv AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, lag(ls[i]) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM (SELECT doc_id, string_split(md, chr(10)) AS ls FROM md), unnest(range(1, len(ls) + 1)) AS u(i))"
S_LINE = strip("line")
on_markdown(
    "content_lines",
    lambda m: E.line_view(m, "doc_id").select("doc_id", T.strip(F.col("line")).alias("t"), "line").groupBy("doc_id").agg(F.count_if(F.expr("t <> '' and t not like '<!--%'")).alias("not_comment"), F.count_if(F.expr("t <> '' and line not like '---%' and line not like '<!--%'")).alias("gate_lines")),
    f"SELECT doc_id, count(*) FILTER (t <> '' AND NOT starts_with(t, '<!--')) AS not_comment, count(*) FILTER (t <> '' AND NOT starts_with(line, '---') AND NOT starts_with(line, '<!--')) AS gate_lines FROM (SELECT *, {S_LINE} AS t FROM lv) GROUP BY 1",
    VIEW,
)
NUMS = r"list_transform(regexp_extract_all(md, '<!-- {0}:(\d+) -->', 1), lambda x: x::BIGINT)"
SEQ = "({0} = list_transform(range(1, len({0}) + 1), lambda x: x::BIGINT))"
on_markdown(
    "marker_extract",
    lambda m: m.select("doc_id", F.array_join(T.numbers_of(F.col("md"), "page").cast("array<string>"), ",").alias("pages"), F.array_join(T.numbers_of(F.col("md"), "reading-order").cast("array<string>"), ",").alias("orders"), F.array_join(F.regexp_extract_all("md", F.lit(r"<!--\s*role:(\w+)"), F.lit(1)), ",").alias("roles"), F.regexp_count("md", F.lit(r"\[uncertain: [^\]]*\]")).alias("uncertain")),
    rf"SELECT doc_id, coalesce(array_to_string({NUMS.format('page')}, ','), '') AS pages, coalesce(array_to_string({NUMS.format('reading-order')}, ','), '') AS orders, coalesce(array_to_string(regexp_extract_all(md, '<!--\s*role:(\w+)', 1), ','), '') AS roles, len(regexp_extract_all(md, '\[uncertain: [^\]]*\]')) AS uncertain FROM md",
)
on_markdown(
    "sequence_check",
    lambda m: m.select("doc_id", T.in_sequence(T.numbers_of(F.col("md"), "page")).alias("pages_ok"), T.in_sequence(T.numbers_of(F.col("md"), "reading-order")).alias("orders_ok")),
    f"SELECT doc_id, {SEQ.format(NUMS.format('page'))} AS pages_ok, {SEQ.format(NUMS.format('reading-order'))} AS orders_ok FROM md",
)
FLEX = r"list_transform(regexp_extract_all(md, '<!--\s*page:\s*(\d+)\s*-->', 1), lambda x: x::BIGINT)"
on_markdown(
    "missing_pages",
    lambda m: m.select("doc_id", F.transform(F.regexp_extract_all("md", F.lit(E.PAGE_MARK), F.lit(1)), lambda x: x.cast("long")).alias("p"))
    .filter("size(p) > 0")
    .select("doc_id", F.explode(F.array_except(F.sequence(F.lit(1).cast("long"), F.array_max("p")), F.col("p"))).alias("page")),
    f"SELECT doc_id, page FROM (SELECT doc_id, p, unnest(range(1, list_max(p) + 1)) AS page FROM (SELECT doc_id, {FLEX} AS p FROM md) WHERE len(p) > 0) WHERE NOT list_contains(p, page)",
)
HAS = f"starts_with({strip('md')}, '---')"
CLOSE = "instr(md[4:], '---')"
on_markdown(
    "frontmatter_parse",
    lambda m: m.select("doc_id", T.has_front_matter(F.col("md")).alias("has"), F.coalesce(T.front_matter(F.col("md")), F.lit("")).alias("block")),
    f"SELECT doc_id, {HAS} AS has, CASE WHEN {CLOSE} > 0 THEN md[4:2 + {CLOSE}] ELSE '' END AS block FROM md",
)
on_markdown(
    "schema_annotate_lines",
    lambda m: m.select("doc_id", E.annotate_lines(F.col("md")).alias("out")),
    f"""SELECT doc_id, string_agg(CASE WHEN t = '' OR starts_with(t, '---') OR starts_with(t, '<!--') OR starts_with(coalesce({strip('prev')}, ''), '<!-- role:') THEN line
  WHEN starts_with(t, '#') THEN '<!-- role:heading level:' || length(regexp_extract(t, '^(#*)', 1)) || ' -->' || chr(10) || line WHEN starts_with(t, '|') THEN '<!-- role:table -->' || chr(10) || line ELSE line END, chr(10) ORDER BY line_no) AS out
FROM (SELECT *, {S_LINE} AS t FROM lv) GROUP BY 1""",
    VIEW,
)
LEVEL = r"length(regexp_extract(line, '^(#{1,6})\s+.', 1))"
on_markdown(
    "normalize_headings",
    lambda m: m.select("doc_id", T.shift_headings(F.col("md")).alias("out")),
    rf"""SELECT doc_id, string_agg(CASE WHEN lv > 0 AND least > 1 THEN regexp_replace(line[least:], '^(#{{1,6}})\s+(.+)$', '\1 \2') ELSE line END, chr(10) ORDER BY line_no) AS out
FROM (SELECT *, min(CASE WHEN lv > 0 THEN lv END) OVER (PARTITION BY doc_id) AS least FROM (SELECT *, {LEVEL} AS lv FROM lv)) GROUP BY 1""",
    VIEW,
)
on_markdown(
    "ensure_page_markers",
    lambda m: m.select("doc_id", E.ensure_page_markers(F.col("md")).alias("out")),
    rf"""SELECT doc_id, CASE WHEN regexp_matches(md, '<!--\s*page:\s*(\d+)\s*-->') OR regexp_matches(tn, '<!--\s*page:\s*(\d+)\s*-->') THEN tn WHEN d > 0 THEN tn[:e] || chr(10) || '<!-- page:1 -->' || chr(10) || tn[e + 1:] ELSE '<!-- page:1 -->' || chr(10) || chr(10) || tn END AS out
FROM (SELECT *, CASE WHEN instr(tn[d + 3:], chr(10)) > 0 THEN instr(tn[d + 3:], chr(10)) + d + 2 ELSE 0 END AS e FROM (SELECT doc_id, md, md AS tn, instr(md[4:], '---') AS d FROM md))""",
)
on_markdown(
    "table_blocks",
    lambda m: E.table_blocks(m, "doc_id").select("doc_id", F.col("first_line").cast("long").alias("first_line"), F.col("n_rows").cast("long").alias("n_rows"), F.array_join("rows", "\n").alias("rows")),
    f"""SELECT doc_id, min(line_no) AS first_line, count(*) AS n_rows, string_agg(t, chr(10) ORDER BY line_no) AS rows FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island
  FROM (SELECT *, {S_LINE} AS t FROM lv) WHERE starts_with(t, '|') AND ends_with(t, '|')) GROUP BY doc_id, island""",
    VIEW,
)
on_markdown("format_table", lambda m: E.table_blocks(m, "doc_id").select("doc_id", F.col("first_line").cast("long").alias("first_line"), F.array_join(E.format_rows(F.col("rows")), "\n").alias("out")),
    r"""SELECT doc_id, first_line, string_agg(CASE WHEN n < 2 THEN t ELSE '| ' || array_to_string(list_transform(range(1, nc + 1), lambda j: CASE WHEN i = 2 AND regexp_matches(coalesce(cells[j], ''), '^:?-+:?$') THEN repeat('-', ws[j]::INT) ELSE rpad(coalesce(cells[j], ''), greatest(ws[j], length(coalesce(cells[j], '')))::INT, ' ') END), ' | ') || ' |' END, chr(10) ORDER BY i) AS out
FROM (SELECT *, list_transform(range(1, nc + 1), lambda j: greatest(3, list_max(list_transform(every, lambda r: CASE WHEN j <= len(r) AND NOT regexp_matches(r[j], '^:?-+:?$') THEN length(r[j]) ELSE 3 END)))) AS ws
  FROM (SELECT *, min(line_no) OVER b AS first_line, count(*) OVER b AS n, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) AS i, max(len(cells)) OVER b AS nc, list(cells) OVER b AS every
    FROM (SELECT *, list_transform(string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) AS cells, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island
      FROM (SELECT *, """ + S_LINE + r""" AS t FROM lv) WHERE starts_with(t, '|') AND ends_with(t, '|')) WINDOW b AS (PARTITION BY doc_id, island))) GROUP BY 1, 2""",
    VIEW,
)
on_markdown(
    "defragment",
    lambda m: X.defragment(m, "doc_id").select("doc_id", F.col("md").alias("out")),
    rf"""SELECT doc_id, string_agg(p, chr(10) ORDER BY run) AS out FROM (SELECT doc_id, run, string_agg(t, ' ' ORDER BY line_no) AS p FROM (SELECT *, sum((b IS NULL OR t = '' OR b = '' OR regexp_matches(b, '[.?!:]$'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run
  FROM (SELECT *, {S_LINE} AS t, {strip('prev')} AS b FROM lv)) GROUP BY 1, 2) GROUP BY 1""",
    VIEW,
)
STYLE = "CASE WHEN regexp_matches(t, '^# ') THEN 'heading1' WHEN regexp_matches(t, '^## ') THEN 'heading2' WHEN regexp_matches(t, '^### ') THEN 'heading3' WHEN regexp_matches(t, '^[-*] ') THEN 'bullet' ELSE 'paragraph' END"
on_markdown("md_to_docx_blocks", lambda m: X.docx_blocks(m, "doc_id"), f"SELECT doc_id, line_no, {STYLE} AS style, CASE WHEN {STYLE} = 'paragraph' THEN t ELSE regexp_replace(t, '^(#{{1,3}}|[-*]) ', '') END AS text FROM (SELECT *, {S_LINE} AS t FROM lv) WHERE t <> ''", VIEW)
BODY = r"regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(t, '^(#{1,6}|[-*+])\s+', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '\*(.+?)\*', '<em>\1</em>', 'g')"
BODY = rf"""regexp_replace({BODY}, '\[(.+?)\]\((.+?)\)', '<a href="\2">\1</a>', 'g')"""
TAG = r"CASE WHEN regexp_matches(t, '^#{1,6}\s') THEN 'h' || length(regexp_extract(t, '^(#{1,6})\s', 1)) WHEN regexp_matches(t, '^[-*+]\s') THEN 'li' WHEN starts_with(t, '|') THEN 'tr' ELSE 'p' END"
on_markdown("md_to_html_blocks", lambda m: X.html_lines(m, "doc_id"), f"SELECT doc_id, line_no, tag, '<' || tag || '>' || {BODY} || '</' || tag || '>' AS html FROM (SELECT *, {TAG} AS tag FROM (SELECT *, {S_LINE} AS t FROM lv)) WHERE t <> '' AND NOT starts_with(t, '<!--') AND NOT starts_with(t, '```')", VIEW)
on_markdown(
    "api_response_json",
    lambda m: m.select("doc_id", X.response(F.col("md"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), F.col("method")).alias("j")).select("doc_id", F.get_json_object("j", "$.filename").alias("filename"), F.get_json_object("j", "$.method").alias("method"), F.get_json_object("j", "$.stats.words").cast("long").alias("words"), F.get_json_object("j", "$.stats.characters").cast("long").alias("characters"), F.md5(F.get_json_object("j", "$.content")).alias("content_md5")),
    f"SELECT doc_id, doc_id || '.pdf' AS filename, method, len({words('md')}) AS words, length(md) AS characters, md5(md) AS content_md5 FROM md",
)
META = "doc_id, 'f' || doc_id || '.pdf' AS source_file, sha256('' || doc_id)[1:16] AS document_id, doc_id % 9 + 1 AS pages, '2024-01-0' || (doc_id % 9 + 1) AS extraction_date, 0.9e0 - (doc_id % 5) * 0.1e0 AS confidence_score, CASE WHEN doc_id % 2 = 0 THEN 'T ' || doc_id ELSE '' END AS title"


def _meta(d: DataFrame) -> DataFrame:
    return d.selectExpr("doc_id", "concat('f', doc_id, '.pdf') AS source_file", "substring(sha2(concat('', doc_id), 256), 1, 16) AS document_id", "doc_id % 9 + 1 AS pages", "concat('2024-01-0', doc_id % 9 + 1) AS extraction_date", "0.9D - (doc_id % 5) * 0.1D AS confidence_score", "CASE WHEN doc_id % 2 = 0 THEN concat('T ', doc_id) ELSE '' END AS title")


on_docs(
    "frontmatter_v2",
    lambda d: (lambda m: m.select("doc_id", E.front_matter_block(m).alias("out")))(_meta(d)),
    f"""SELECT doc_id, concat_ws(chr(10), '---', 'document:', '  source_file: "' || source_file || '"', '  document_id: "' || document_id || '"', '  pages: ' || pages, '  extraction_method: "unknown"', '  extraction_date: "' || extraction_date || '"', '  language: "en"', '', 'quality:',
  '  confidence_score: ' || printf('%.4f', confidence_score), '', 'metadata:', CASE WHEN title <> '' THEN '  title: "' || title || '"' END, '---', '') AS out FROM (SELECT {META} FROM documents)""",
)
on_docs(
    "frontmatter_v1",
    lambda d: (lambda m: m.select("doc_id", E.front_matter_flat(m, F.lit("lines"), F.col("confidence_score")).alias("out")))(_meta(d)),
    f"""SELECT doc_id, concat_ws(chr(10), '---', 'document:', '  source_file: "' || source_file || '"', '  pages: ' || pages, '  extraction_method: "lines"', '  extraction_date: "' || extraction_date || '"', '  confidence_score: ' || printf('%.2f', confidence_score), '  language: "en"', '  document_id: "' || document_id || '"', '',
  'metadata:', CASE WHEN title <> '' THEN '  title: "' || title || '"' END, '---', '') AS out FROM (SELECT {META} FROM documents)""",
)
on_markdown("schema_enforce", lambda m: E.enforce(m.select("doc_id", "md", F.lit("x.pdf").alias("source_file"), F.lit("i").alias("document_id"), F.lit("d").alias("extraction_date")), "doc_id").select("doc_id", F.md5("md").alias("md5"), F.length("md").alias("n")))
END = r"CASE WHEN starts_with(md, '---') AND instr(md[4:], chr(10) || '---' || chr(10)) > 0 THEN instr(md[4:], chr(10) || '---' || chr(10)) ELSE 0 END"
on_markdown(
    "schema_violations",
    lambda m: E.violations(m, "doc_id"),
    rf"""SELECT doc_id, type FROM (SELECT doc_id, unnest([CASE WHEN NOT {HAS} THEN 'missing_frontmatter' END, CASE WHEN e > 0 AND (NOT contains(md[4:3 + e], 'source_file:') OR NOT contains(md[4:3 + e], 'document_id:')) THEN 'missing_fields' END,
  CASE WHEN NOT regexp_matches(md, '<!--\s*page:\s*(\d+)\s*-->') THEN 'no_page_markers' END, CASE WHEN list_min(list_transform(regexp_extract_all(md, '(?m)^(#{{1,6}})\s+.+$', 1), lambda x: length(x))) > 1 THEN 'heading_hierarchy' END]) AS type FROM (SELECT *, {END} AS e FROM md)) WHERE type IS NOT NULL""",
)
on_markdown(
    "schema_validate_only",
    lambda m: E.check_only(m, "doc_id"),
    rf"SELECT doc_id, {HAS} AS is_valid, NOT regexp_matches(md, '<!--\s*page:\s*(\d+)\s*-->') AS missing_page_markers, len(regexp_extract_all(md, '<!--\s*role:(\w+)(?:\s+[^>]+)?\s*-->')) AS role_annotations, len(regexp_extract_all(md, '<!--\s*page:\s*(\d+)\s*-->')) AS page_markers FROM md",
)

# Web pages.
QUERIES["html_blocks"] = lambda spark, sf_dir: html_blocks(_table(spark, sf_dir, "pages"))
SQL["html_blocks"] = r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
x AS (SELECT page_id, string_split(regexp_replace(h, '(?i)<(h1|p|li|title|footer)\b', chr(1) || '\1', 'g'), chr(1)) AS xs FROM b),
y AS (SELECT page_id, i - 2 AS elem_idx, xs[i] AS s FROM x, unnest(range(2, len(xs) + 1)) AS u(i)),
z AS (SELECT page_id, elem_idx, lower(regexp_extract(s, '^(\w+)', 1)) AS tag, regexp_replace('<' || s, '(?is)</?(?:h1|p|li|title|footer|ul|div|article|body)\b.*$', '') AS none, s FROM y)
SELECT page_id, elem_idx, tag, CASE WHEN tag = 'li' THEN '• ' ELSE '' END || trim(regexp_replace(regexp_replace(regexp_replace(substr(s, instr(s, '>') + 1), '(?is)</?(?:h1|p|li|title|footer|ul|div|article|body)\b.*$', ''), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS content,
  CASE WHEN tag = 'h1' THEN 24e0 ELSE 12e0 END AS font_size FROM z"""

# State tables: runs from events, a catalogue from parts.
RUNS = "event_id AS run_id, event_type AS filename, ts, value AS elapsed, user_id * 100 AS words, props"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*[x.strip() for x in RUNS.split(",")], "'digital' AS method")


QUERIES["usage_stats"] = lambda spark, sf_dir: ST.usage(_runs(spark, sf_dir))
SQL["usage_stats"] = f"SELECT count(*) AS total_conversions, sum(words)::BIGINT AS total_words, count(*) AS total_files, round(avg(elapsed)::DECIMAL(28, 9), 6)::DOUBLE AS avg_time FROM (SELECT {RUNS} FROM events)"
USED = f"SELECT count(*) AS n, sum(words)::BIGINT AS w, round(avg(elapsed)::DECIMAL(28, 9), 6)::DOUBLE AS a FROM (SELECT {RUNS} FROM events)"
QUERIES["usage_update"] = lambda spark, sf_dir: (lambda runs: ST.update_usage(ST.usage(runs.filter("run_id % 10 <> 0")), runs.filter("run_id % 10 = 0")))(_runs(spark, sf_dir))
SQL["usage_update"] = f"SELECT o.n + m.n AS total_conversions, o.w + m.w AS total_words, o.n + m.n AS total_files, round(((o.a * o.n + m.a * m.n) / (o.n + m.n))::DECIMAL(28, 9), 6)::DOUBLE AS avg_time FROM ({USED} WHERE run_id % 10 <> 0) o, ({USED} WHERE run_id % 10 = 0) m"
QUERIES["usage_display"] = lambda spark, sf_dir: ST.usage_display(ST.usage(_runs(spark, sf_dir)))
SQL["usage_display"] = f"SELECT '**Usage Statistics**' || chr(10) || chr(10) || '**Total Conversions:** ' || n || chr(10) || '**Total Words:** ' || format('{{:,}}', w) || chr(10) || '**Avg Time:** ' || printf('%.1f', a) || 's' || chr(10) AS shown FROM ({USED})"
QUERIES["history_save"] = lambda spark, sf_dir: (lambda runs: ST.save_history(ST.history(runs.filter("run_id % 2 = 0")), runs.filter("run_id % 2 = 1")))(_runs(spark, sf_dir)).select("run_id", "filename")
SQL["history_save"] = f"SELECT run_id, filename FROM (SELECT {RUNS} FROM events) ORDER BY ts DESC, run_id DESC LIMIT 10"
QUERIES["history_topk"] = lambda spark, sf_dir: ST.history(_runs(spark, sf_dir)).select("run_id", "filename", F.date_format("ts", "MM/dd HH:mm").alias("shown"))
SQL["history_topk"] = f"SELECT run_id, filename, strftime(ts, '%m/%d %H:%M') AS shown FROM (SELECT {RUNS} FROM events) ORDER BY ts DESC, run_id DESC LIMIT 10"
QUERIES["history_display"] = lambda spark, sf_dir: ST.history_lines(_runs(spark, sf_dir))
SQL["history_display"] = f"SELECT run_id, '- **' || filename || '** (' || strftime(ts, '%m/%d %H:%M') || ')' || chr(10) || '  ' || format('{{:,}}', words) || ' words • digital' AS entry FROM (SELECT {RUNS} FROM events) ORDER BY ts DESC, run_id DESC LIMIT 5"
QUERIES["running_avg_time"] = lambda spark, sf_dir: ST.running_average(_runs(spark, sf_dir), "filename").select("run_id", "avg_time")
SQL["running_avg_time"] = f"SELECT run_id, round((avg(elapsed) OVER (PARTITION BY filename ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING))::DECIMAL(28, 9), 6)::DOUBLE AS avg_time FROM (SELECT {RUNS} FROM events)"
QUERIES["json_state_permissive"] = lambda spark, sf_dir: _runs(spark, sf_dir).select("run_id", F.expr("CASE WHEN run_id % 10 = 0 THEN '{ invalid json }' ELSE props END").alias("j")).select("run_id", F.coalesce(F.from_json("j", "k long")["k"], F.lit(0)).alias("k"))
SQL["json_state_permissive"] = "SELECT event_id AS run_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE coalesce((props->>'k')::BIGINT, 0) END AS k FROM events"


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    key = ST.cache_key(F.md5("text"), F.concat(F.lit("RapidOCR_"), (F.col("doc_id") % 3 * 100).cast("string")), F.lit("md"))
    requests = docs.select("doc_id", key.alias("cache_key"))
    entries = docs.filter("doc_id % 4 <> 0").select(key.alias("cache_key"), F.col("text").alias("markdown"), "doc_id").groupBy("cache_key").agg(F.min_by("markdown", "doc_id").alias("markdown"), F.lit("digital").alias("method"))
    return requests, entries


CACHE = "rq AS (SELECT doc_id, md5(text) || '_RapidOCR_' || (doc_id % 3 * 100) || '_md' AS cache_key, text FROM documents), en AS (SELECT cache_key, min(text) AS markdown FROM rq WHERE doc_id % 4 <> 0 GROUP BY 1)"
QUERIES["cache_probe"] = lambda spark, sf_dir: ST.probe(*_cache(spark, sf_dir)).select("doc_id", "cache_key", "cached")
SQL["cache_probe"] = f"WITH {CACHE} SELECT doc_id, cache_key, markdown IS NOT NULL AS cached FROM rq LEFT JOIN en USING (cache_key)"
QUERIES["cache_misses"] = lambda spark, sf_dir: ST.misses(*_cache(spark, sf_dir)).select("doc_id")
SQL["cache_misses"] = f"WITH {CACHE} SELECT doc_id FROM rq WHERE cache_key NOT IN (SELECT cache_key FROM en)"
QUERIES["cache_size_mb"] = lambda spark, sf_dir: ST.size_mb(_cache(spark, sf_dir)[1])
SQL["cache_size_mb"] = f"WITH {CACHE} SELECT round(sum(strlen(markdown)) / 1048576e0, 6) AS cache_mb FROM en"
QUERIES["route_engine"] = lambda spark, sf_dir: (lambda rows: rows.select("doc_id", F.when(F.col("cached"), "cache").when(F.col("doc_id") % 5 == 0, F.when(F.col("markdown_text").contains("Error"), "ocr (fallback)").otherwise("model")).when((F.length(T.strip(F.col("markdown_text"))) > 100) & (F.size(T.words(F.col("markdown_text"))) > 100), "digital").otherwise("ocr").alias("engine")))(
    ST.probe(*_cache(spark, sf_dir)).join(_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 35 == 0, F.concat(F.lit("Error "), F.col("text"))).otherwise(F.col("text")).alias("markdown_text")), "doc_id")
)
SQL["route_engine"] = f"WITH {CACHE} SELECT doc_id, CASE WHEN markdown IS NOT NULL THEN 'cache' WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 35 = 0 OR contains(text, 'Error') THEN 'ocr (fallback)' ELSE 'model' END WHEN length({strip('text')}) > 100 AND len({words('text')}) > 100 THEN 'digital' ELSE 'ocr' END AS engine FROM rq LEFT JOIN en USING (cache_key)"

CATALOGUE = "p_partkey AS id, lower(p_name) AS name, CASE WHEN p_partkey % 11 = 0 THEN 'N/A' ELSE cast(p_partkey % 97 AS STRING) END AS input_cost, CASE p_partkey % 4 WHEN 0 THEN 'text+image->text' WHEN 1 THEN 'multimodal' ELSE 'text->text' END AS modality, CASE p_partkey % 7 WHEN 0 THEN 'qwen-vl' WHEN 1 THEN 'qwen' WHEN 2 THEN 'pixtral' WHEN 3 THEN 'gemini' ELSE 'other' END AS family"
KEEP = "(modality LIKE '%multimodal%' OR modality LIKE '%vision%' OR family LIKE '%pixtral%' OR (family LIKE '%qwen%' AND family LIKE '%vl%') OR family LIKE '%gemini%' OR family LIKE '%nemotron%' OR family LIKE '%llava%' OR family LIKE '%glm%')"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.sources.elements import _split_columns

    return _table(spark, sf_dir, "part").selectExpr(*_split_columns(CATALOGUE))


QUERIES["model_catalog_scan"] = lambda spark, sf_dir: _catalogue(spark, sf_dir).selectExpr("id", "CASE WHEN length(name) > 10 THEN concat(substring(name, 1, 10), '...') ELSE name END AS short", "try_cast(input_cost AS DOUBLE) AS price")
SQL["model_catalog_scan"] = f"SELECT id, CASE WHEN length(name) > 10 THEN name[1:10] || '...' ELSE name END AS short, try_cast(input_cost AS DOUBLE) AS price FROM (SELECT {CATALOGUE} FROM part)"
QUERIES["model_catalog_filter"] = lambda spark, sf_dir: _catalogue(spark, sf_dir).filter(KEEP).select("id", "family", "modality")
SQL["model_catalog_filter"] = f"SELECT id, family, modality FROM (SELECT {CATALOGUE} FROM part) WHERE {KEEP}"
QUERIES["model_topk"] = lambda spark, sf_dir: _catalogue(spark, sf_dir).filter(KEEP).withColumn("price", F.expr("try_cast(input_cost AS DOUBLE)")).filter("family rlike 'qwen|pixtral|gemini|nemotron|ocr|document'").orderBy(F.asc_nulls_last("price"), "id").limit(10).select("id", "family", "price")
SQL["model_topk"] = f"SELECT id, family, try_cast(input_cost AS DOUBLE) AS price FROM (SELECT {CATALOGUE} FROM part) WHERE {KEEP} AND regexp_matches(family, 'qwen|pixtral|gemini|nemotron|ocr|document') ORDER BY price ASC NULLS LAST, id LIMIT 10"

# Event time.
QUERIES["usage_windows"] = lambda spark, sf_dir: usage_windows(_table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))
SQL["usage_windows"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES["usage_sessions"] = lambda spark, sf_dir: usage_sessions(_table(spark, sf_dir, "events")).select("user_id", F.col("start"), "n")
SQL["usage_sessions"] = """SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS nw FROM events)) GROUP BY user_id, s"""
