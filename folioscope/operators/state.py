"""Cache, history and usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import safe_file_name
from folioscope.runtime import drop, written

ENTRY = "cache_key string, markdown string, method string, cached_at timestamp"
USAGE = ["total_conversions", "total_words", "total_files", "avg_time"]


def cache_key(file_hash: Column, engine: Column, export_format: Column) -> Column:
    clean = F.regexp_replace(engine, r'[\\/*?:"<>|]', "_")
    return safe_file_name(F.concat_ws("_", file_hash, clean, export_format))


def probe(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with `cached`, markdown and method of the entry that they find."""
    return requests.join(cache.select("cache_key", "markdown", F.col("method").alias("cached_method")), "cache_key", "left").withColumn("cached", F.col("markdown").isNotNull())


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "cache_key", "left_anti")


def save(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with the new entries in place of those with their keys."""
    return cache.join(new, "cache_key", "left_anti").unionByName(new)


def size_mb(cache: DataFrame) -> DataFrame:
    return cache.agg(F.round(F.coalesce(F.sum(F.octet_length("markdown")), F.lit(0)) / 1048576.0, 6).alias("cache_mb"))


def clear(table: DataFrame) -> DataFrame:
    """A cache or history without entries, with the same columns."""
    return table.limit(0)


def write_back(table: DataFrame, path: str) -> None:
    """Overwrite the state below path. The new state may be made from the old: it is written elsewhere before the old one goes."""
    made = written(table, "state")
    made.write.mode("overwrite").parquet(path)
    drop(made)


def history(runs: DataFrame, most: int = 10) -> DataFrame:
    """The newest runs: ts, filename, words, method. Ties go to the larger run_id."""
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(most)


def save_history(kept: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    """The history with new runs, of which the newest stay."""
    return history(kept.unionByName(new), most)


def history_lines(runs: DataFrame, most: int = 5) -> DataFrame:
    shown = F.concat(F.lit("- **"), F.col("filename"), F.lit("** ("), F.date_format("ts", "MM/dd HH:mm"), F.lit(")\n  "), F.format_string("%,d", F.col("words")), F.lit(" words • "), F.col("method"))
    return history(runs, most).select("run_id", shown.alias("entry"))


def usage(runs: DataFrame) -> DataFrame:
    """One row: conversions, words, files and mean time; zeros without runs."""
    return runs.agg(F.count("*").alias("total_conversions"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"), F.count("*").alias("total_files"), F.round(F.round(F.coalesce(F.avg("elapsed"), F.lit(0.0)), 9), 6).alias("avg_time"))


def update_usage(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """The row of usage() after more runs, without reading the runs before. Means are weighed by conversions."""
    both = stats.select(*USAGE).unionByName(usage(runs))
    mean = F.coalesce(F.try_divide(F.sum(F.col("avg_time") * F.col("total_conversions")), F.sum("total_conversions")), F.lit(0.0))
    return both.agg(*[F.sum(c).alias(c) for c in USAGE[:3]], F.round(F.round(mean, 9), 6).alias("avg_time"))


def usage_display(stats: DataFrame) -> DataFrame:
    """The row of usage() as Markdown."""
    shown = F.format_string("**Usage Statistics**\n\n**Total Conversions:** %d\n**Total Words:** %,d\n**Avg Time:** %.1fs\n", "total_conversions", "total_words", "avg_time")
    return stats.select(shown.alias("shown"))


def running_average(runs: DataFrame, by: str) -> DataFrame:
    """runs with the mean time of all runs of `by` so far: sums of the days before, and a window within the day."""
    rows = runs.withColumn("__day", F.to_date("ts"))
    days = rows.groupBy(by, "__day").agg(F.sum("elapsed").alias("s"), F.count("elapsed").alias("n"))
    earlier = Window.partitionBy(by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(F.col(by).alias("__by"), F.col("__day").alias("__d"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"))
    w = Window.partitionBy(by, "__day").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__own", F.coalesce(F.sum("elapsed").over(w), F.lit(0.0))).withColumn("__count", F.count("elapsed").over(w))
    joined = own.join(starts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__day").eqNullSafe(F.col("__d")))
    mean = F.try_divide(F.col("__s") + F.col("__own"), F.col("__n") + F.col("__count"))
    return joined.select(*runs.columns, F.round(F.round(mean, 9), 6).alias("avg_time"))
