"""Language by script and by frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.patterns import COMMON_WORDS, SCRIPT_LANGUAGES, SCRIPTS
from folioscope.functions.text import strip

DEFAULT = "en"


def _letters(text: Column, low: int, high: int) -> Column:
    return F.regexp_count(text, F.lit(rf"[\p{{L}}&&[\x{{{low:04X}}}-\x{{{high:04X}}}]]"))


def script(text: Column) -> Column:
    """A struct of script and share of the letters; ties go to the script whose letter comes first in the text."""
    counts = []
    for name, (low, high) in SCRIPTS.items():
        n = _letters(text, low, high)
        first = _before(text, low, high)
        # Where it comes first matters for a script that occurs.
        counts.append(F.struct(n.alias("n"), F.when(n > 0, -first).alias("p"), F.lit(name).alias("s")))
    return _most(counts, F.regexp_count(text, F.lit(r"\p{L}")))


def _before(text: Column, low: int, high: int) -> Column:
    return F.length(F.regexp_extract(text, rf"(?s)^(.*?)[\p{{L}}&&[\x{{{low:04X}}}-\x{{{high:04X}}}]]", 1))


def _most(counts: list[Column], letters: Column) -> Column:
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, F.struct(best["s"].alias("script"), (best["n"] / letters).alias("share"))).otherwise(F.struct(F.lit("unknown").alias("script"), F.lit(0.0).alias("share")))


def latin_words(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters alone."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike("^[a-z]+$")))


def latin_language(words: Column) -> Column:
    """A struct of language and confidence: the most frequent words found, ties to the earlier language."""
    known = {lang: F.array(*[F.lit(w) for w in dict.fromkeys(common.split())]) for lang, common in COMMON_WORDS.items()}
    return _by_words(F.size(words), {lang: F.size(F.array_intersect(words, own)) for lang, own in known.items()})


def _by_words(total: Column, found: dict[str, Column]) -> Column:
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("o"), F.lit(lang).alias("l")) for k, (lang, n) in enumerate(found.items())]))
    sure = F.least(F.lit(1.0), best["n"] / total * 5)
    return F.when((total > 0) & (best["n"] > 0), F.struct(best["l"].alias("language"), sure.alias("confidence"))).otherwise(F.struct(F.lit(DEFAULT).alias("language"), F.lit(0.0).alias("confidence")))


def detect(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep and language, confidence, script, method of each row's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("__t", text).withColumn("__s", script(F.col("__t"))).withColumn("__l", latin_language(latin_words(F.col("__t"))))
    t = F.col("__t")
    return rows.select(*keep, *_verdict(F.length(strip(t)) < 10, _kana(t), _hangul(t)))


def _kana(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}]"))


def _hangul(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{AC00}-\x{D7AF}]"))


def _verdict(short: Column, kana: Column, hangul: Column) -> list[Column]:
    """language, confidence, script and method by __s of script() and __l of latin_language()."""
    s = F.col("__s.script")
    by_script = F.create_map(*[F.lit(x) for kv in SCRIPT_LANGUAGES.items() for x in kv])
    cjk = F.when(kana > 5, "ja").when(hangul > 5, "ko").otherwise("zh")
    mapped = by_script[s]
    language = F.when(short, DEFAULT).when(mapped.isNotNull(), mapped).when(s == "cjk", cjk).when(s == "latin", F.col("__l.language")).otherwise(DEFAULT)
    sure = F.when(short, 0.0).when(mapped.isNotNull() | (s == "cjk"), F.col("__s.share")).when(s == "latin", F.col("__l.confidence")).otherwise(0.0)
    method = F.when(short, "insufficient_text").when(mapped.isNotNull(), "script").when(s == "cjk", "cjk_analysis").when(s == "latin", "word_frequency").otherwise("fallback")
    return [language.alias("language"), F.round(sure, 4).alias("confidence"), F.when(short, "unknown").otherwise(s).alias("script"), method.alias("method")]


def detect_pieces(pieces: DataFrame, key: str, order: str, md: str = "md") -> DataFrame:
    """(key, language, confidence, script, method) as detect() has them of each key's pieces in a row, which are pages: a word ends with its page, and ten characters there are."""
    t = F.col(md)
    # Letters of other scripts are counted in what Latin leaves, which mostly is little.
    latin, letter = SCRIPTS["latin"], F.lit(r"\p{L}")
    rest = pieces.select(key, order, md, F.regexp_replace(t, rf"[\x{{{latin[0]:04X}}}-\x{{{latin[1]:04X}}}]+", "").alias("__r"), F.regexp_count(t, letter).alias("letters"))
    each = rest.select(key, order, md, "letters", _kana(F.col("__r")).alias("kana"), _hangul(F.col("__r")).alias("hangul"), *[(F.col("letters") - F.regexp_count("__r", letter) if name == "latin" else _letters(F.col("__r"), *span)).alias(f"n_{name}") for name, span in SCRIPTS.items()])
    placed = each.select(*[c for c in each.columns if c != md], *[F.when(F.col(f"n_{name}") > 0, F.struct((-F.col(order)).alias("o"), (-_before(t, *span)).alias("p"))).alias(f"p_{name}") for name, span in SCRIPTS.items()])
    sums = [F.sum(c).alias(c) for c in ("letters", "kana", "hangul", *[f"n_{name}" for name in SCRIPTS])] + [F.max(f"p_{name}").alias(f"p_{name}") for name in SCRIPTS]
    words = pieces.select(key, F.explode(latin_words(t)).alias("w")).distinct()
    known = [F.count_if(F.col("w").isin(common.split())).alias(f"w_{lang}") for lang, common in COMMON_WORDS.items()]
    joined = placed.groupBy(key).agg(*sums).join(words.groupBy(key).agg(F.count("*").alias("words"), *known), key, "left")
    counts = [F.struct(F.col(f"n_{name}").alias("n"), F.col(f"p_{name}").alias("p"), F.lit(name).alias("s")) for name in SCRIPTS]
    found = {lang: F.coalesce(f"w_{lang}", F.lit(0)) for lang in COMMON_WORDS}
    rows = joined.withColumn("__s", _most(counts, F.col("letters"))).withColumn("__l", _by_words(F.coalesce("words", F.lit(0)), found))
    return rows.select(key, *_verdict(F.lit(False), F.col("kana"), F.col("hangul")))


def detect_documents(pages: DataFrame, first: int = 5) -> DataFrame:
    """(doc_key, language, ...): by the first pages of each document, joined by a blank. pages: doc_key, page_num, text."""
    few = pages.filter(F.col("page_num") <= first).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("ps"))
    return detect(few.withColumn("text", F.array_join(F.transform("ps", lambda p: p["text"]), " ")), "text", ["doc_key"])
