"""Confidence statistics of documents, pages, element types and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import page_quality

LOW, CRITICAL = 0.7, 0.5


def clamped(confidence: Column) -> Column:
    """A confidence between 0 and 1; 1 where it is missing or no number."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence.try_cast("double"), F.lit(1.0))))


def records(elements: DataFrame) -> DataFrame:
    """(doc_key, page_num, element_id, confidence, element_type, source): ids count through a document."""
    n = F.row_number().over(Window.partitionBy("doc_key").orderBy("page_num", "elem_idx"))
    source = F.col("source") if "source" in elements.columns else F.lit("ocr")
    return elements.select(
        "doc_key",
        "page_num",
        F.concat_ws("_", F.lit("elem"), F.col("page_num").cast("string"), n.cast("string")).alias("element_id"),
        clamped(F.col("confidence")).alias("confidence"),
        F.coalesce("elem_type", F.lit("text")).alias("element_type"),
        source.alias("source"),
    )


def r4(value: Column) -> Column:
    """Four places; rounded to nine first, so that sums taken in another order round alike."""
    return F.round(F.round(value, 9), 4)


def _stats(low: float, critical: float) -> list[Column]:
    c = F.col("c")
    share = lambda limit: F.round(F.round(F.count_if(c < limit) / F.count("*") * 100, 9), 2)
    return [
        r4(F.avg(c)).alias("avg"),
        r4(F.min(c)).alias("min"),
        r4(F.max(c)).alias("max"),
        r4(F.median(c)).alias("median"),
        r4(F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias("std_dev"),
        F.count("*").alias("total_elements"),
        F.count_if(c < low).alias("uncertain_count"),
        share(low).alias("uncertain_percentage"),
        F.count_if(c < critical).alias("low_confidence_count"),
        share(critical).alias("low_confidence_percentage"),
    ]


def _rows(elements: DataFrame) -> DataFrame:
    source = F.col("source") if "source" in elements.columns else F.lit("ocr")
    return elements.select("doc_key", "page_num", F.coalesce("elem_type", F.lit("text")).alias("elem_type"), source.alias("source"), clamped(F.col("confidence")).alias("c"))


def statistics(elements: DataFrame, documents: DataFrame | None = None, low: float = LOW, critical: float = CRITICAL) -> DataFrame:
    """One row per document. documents (doc_key): those without elements get 1.0 and zeros."""
    out = _rows(elements).groupBy("doc_key").agg(*_stats(low, critical))
    if documents is None:
        return out
    filled = documents.select("doc_key").distinct().join(out, "doc_key", "left")
    ones = {k: 1.0 for k in ("avg", "min", "max", "median")}
    return filled.fillna(ones | {k: 0.0 for k in ("std_dev", "uncertain_percentage", "low_confidence_percentage")} | {k: 0 for k in ("total_elements", "uncertain_count", "low_confidence_count")})


def by_page(elements: DataFrame, low: float = LOW) -> DataFrame:
    c = F.col("c")
    return _rows(elements).groupBy("doc_key", "page_num").agg(r4(F.avg(c)).alias("avg"), r4(F.min(c)).alias("min"), r4(F.max(c)).alias("max"), F.count("*").alias("element_count"), F.count_if(c < low).alias("uncertain_count"))


def by_type(elements: DataFrame) -> DataFrame:
    return _rows(elements).groupBy("doc_key", "elem_type").agg(r4(F.avg("c")).alias("avg"), r4(F.min("c")).alias("min"), F.count("*").alias("n"))


def by_source(elements: DataFrame) -> DataFrame:
    return _rows(elements).groupBy("doc_key", "source").agg(r4(F.avg("c")).alias("avg"), F.count("*").alias("n"))


def grouping_sets(elements: DataFrame) -> DataFrame:
    """All four groupings of the report in one pass over the elements."""
    rows = _rows(elements)
    sets = [[F.col("doc_key")], [F.col("doc_key"), F.col("page_num")], [F.col("doc_key"), F.col("elem_type")], [F.col("doc_key"), F.col("source")]]
    grouped = rows.groupingSets(sets, *(F.col(n) for n in ("doc_key", "page_num", "elem_type", "source")))
    return grouped.agg(F.grouping_id().alias("gid"), r4(F.avg("c")).alias("avg"), r4(F.min("c")).alias("min"), F.count("*").alias("n"))


def low_regions(elements: DataFrame, threshold: float = LOW) -> DataFrame:
    return records(elements).filter(F.col("confidence") < threshold)


def page_summary(elements: DataFrame, low: float = LOW) -> DataFrame:
    c = F.col("c")
    rows = _rows(elements).groupBy("doc_key", "page_num").agg(F.avg(c).alias("a"), F.count("*").alias("element_count"), F.count_if(c < low).alias("uncertain_count"))
    return rows.select("doc_key", "page_num", r4(F.col("a")).alias("avg_confidence"), page_quality(F.round("a", 9)).alias("quality"), "element_count", "uncertain_count", (F.round("a", 9) < low).alias("needs_review"))


def overall(stats: DataFrame) -> DataFrame:
    """(doc_key, score): weighted from the rounded statistics."""
    score = 0.6 * F.col("avg") + 0.2 * F.col("min") + 0.2 * (1.0 - F.col("uncertain_percentage") / 100.0)
    return stats.select("doc_key", r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"))


def yaml_fields(stats: DataFrame) -> DataFrame:
    scored = overall(stats).withColumnRenamed("score", "confidence_score")
    return stats.join(scored, "doc_key").select("doc_key", "confidence_score", F.col("avg").alias("confidence_avg"), F.col("min").alias("confidence_min"), F.col("uncertain_count").alias("uncertain_regions"), "uncertain_percentage", F.col("low_confidence_count").alias("low_confidence_regions"))


def split_by_confidence(elements: DataFrame, threshold: float = LOW) -> DataFrame:
    """elements with `uncertain`."""
    return elements.withColumn("uncertain", ~(F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)) >= threshold))
