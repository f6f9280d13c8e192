"""Table expressions for DuckDB that the queries' SQL starts from: the same fixtures as in sources.elements."""

from folioscope.sources.elements import COLUMNS_SQL, LINE_SQL, PREFIX_SQL

LINES = """pg AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_num FROM documents),
ln AS (SELECT source AS doc_key, doc_id, page_num, i - 1 AS elem_idx, trim(ls[i]) AS raw, doc_id * 31 + (i - 1) * 7 AS k
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM pg), unnest(range(1, len(ls) + 1)) AS u(i))"""
ELEMENTS = f"{LINES},\nel AS (SELECT {COLUMNS_SQL} FROM ln)"
PG = "doc_key, page_num"
STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
MARKDOWN = f"""m0 AS (SELECT doc_id, source, i - 1 AS elem_idx, trim(ls[i]) AS raw, doc_id * 31 + (i - 1) * 7 AS k
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
m1 AS (SELECT doc_id, source, string_agg({LINE_SQL}, chr(10) ORDER BY elem_idx) AS body FROM m0 GROUP BY 1, 2),
md AS (SELECT doc_id, {PREFIX_SQL} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<!-- page:1 -->' || chr(10) END || body AS md, doc_id % 3 + 1 AS page_count,
  CASE doc_id % 5 WHEN 0 THEN 'RapidOCR' WHEN 1 THEN 'OpenRouter (x)' WHEN 2 THEN 'pymupdf4llm' WHEN 3 THEN 'GMFT' ELSE 'other' END AS method FROM m1)"""


def strip(x: str) -> str:
    return STRIP.format(x)


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def any_of(x: str, patterns: list[str], flag: str = "") -> str:
    """Does any pattern match? Classes of Unicode are the same in both engines as the patterns write them."""
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " OR ".join(f"regexp_matches({x}, '{flag}{p}')" for p in quoted) + ")"


def over_elements(select: str, more: str = "") -> str:
    return f"WITH {ELEMENTS}{', ' + more if more else ''}\n{select}"


def over_markdown(select: str, more: str = "") -> str:
    return f"WITH {MARKDOWN}{', ' + more if more else ''}\n{select}"
