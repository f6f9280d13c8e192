"""Structured Streaming forms: new documents through the pipeline, and usage over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folioscope.plans.document import process_documents
from folioscope.runtime import drop
from folioscope.sources.elements import elements


def process_new_documents(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Run the pipeline on the documents that have arrived since the last call.

    A batch has a folder of its own below `out`, which a replay writes anew, so a report is there once. Pages of a
    source go on from the batches before, whose counts lie in `out` + "_pages". What a batch writes between is removed.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        counts = rows.groupBy("source").agg(F.count("*").alias("pages"))
        counts.write.mode("overwrite").parquet(f"{out}_pages/batch={number}")
        seen = spark.read.schema("source string, pages long, batch long").parquet(f"{out}_pages").filter(F.col("batch") < number)
        markdown, report = process_documents(elements(rows, seen.groupBy("source").agg(F.sum("pages").alias("pages"))))
        report.write.mode("overwrite").parquet(f"{out}/batch={number}")
        drop(markdown)
        drop(report)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and mean times per event type and time window; events later than `late` are left out. Works on streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def usage_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events with less than `gap` between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
