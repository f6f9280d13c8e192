"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.ann import op7_ann
from folioscope.llm.bpe import op6_bpe
from folioscope.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from folioscope.llm.html_extract import op4_html
from folioscope.llm.language import op1_language
from folioscope.llm.mixing import op9_mixing, op9_sql
from folioscope.llm.quality import op8_quality
from folioscope.llm.simhash import op10_simhash
from folioscope.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from folioscope.llm.token_store import op2_token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language, op2_token_store, op3_substring_dedup, op4_html, op5_exact_dedup, op6_bpe, op7_ann, op8_quality, op9_mixing, op10_simhash]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op9_mixing": op9_sql()}
