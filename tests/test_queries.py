"""Every registered query of the document engine against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", "hyphen_merge_strict hyphen_merge_loose clean_artifacts normalize_markdown strip_comments md_to_txt md_to_txt_code sanitize_filename fold_case".split())
def test_whole_text_is_cleaned(spark, tmp_path, name):
    """What stands after character 70 is cleaned as well; only a file name ends after 200 characters."""
    filler = "plain words " * 10
    docs = spark.createDataFrame([(1, filler + "Far bro-\nken **far** <!-- far --> [far](y)   `far`\n* far", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()[name](spark, str(tmp_path)).first().out
    tail = {
        "hyphen_merge_strict": "Far broken **far**", "hyphen_merge_loose": "Far broken **far**", "clean_artifacts": "[far](y) `far`", "normalize_markdown": "`far`\n- far", "strip_comments": "**far**  [far](y)",
        "md_to_txt": "ken far <!-- far --> far   `far`", "md_to_txt_code": "ken far <!-- far --> far   far", "sanitize_filename": "plain_words_" * 9, "fold_case": "far bro- ken **far**",
    }
    assert out.count(tail[name]) == (1 if name == "sanitize_filename" else 2)
