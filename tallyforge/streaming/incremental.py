"""Incremental ingest as a stream of files, event-time windows, and the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.landing import parse_files


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Parses all files not seen before and appends their cells to ``out``; returns when none is left. The stream's checkpoint
    remembers files by path, the content id drops those that came under another name; ``after`` rebuilds what follows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    named = files.select(F.sha2("content", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def land(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["file_id"])
        try:
            done = spark.read.parquet(out).filter("status = 'parsed'").select("file_id").distinct()
            fresh = fresh.join(done, "file_id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        # a batch that is run again after a failure replaces what it wrote before
        parse_files(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        if after:
            after(spark.read.parquet(out), number)

    named.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key of a stream or table; in a stream rows later than ``late`` are dropped. Naive times are read as UTC."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    return timed.withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def append_events(spark: SparkSession, log: str, events: DataFrame, last_seq: int) -> int:
    """Appends events(kind, payload, at) with the following numbers; returns the last. One writer at a time."""
    from pyspark.sql import Window as W

    numbered = events.withColumn("seq", F.row_number().over(W.orderBy("at", "kind", "payload")) + F.lit(last_seq)).cache()
    numbered.write.mode("append").parquet(log)
    last = numbered.agg(F.coalesce(F.max("seq"), F.lit(last_seq)).alias("m")).first()["m"]
    numbered.unpersist()
    return last


def replay_events(spark: SparkSession, log: str, since: int) -> DataFrame:
    """Events after ``since`` in order; a reader that is ahead of the log starts again from the first."""
    events = spark.read.parquet(log)
    last = events.agg(F.max("seq").alias("m")).first()["m"]
    return (events if last is None or last < since else events.filter(F.col("seq") > since)).orderBy("seq")
