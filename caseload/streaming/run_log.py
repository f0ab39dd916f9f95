"""Streams over a log of events: late rows, repeats, windows, and the last value of each key.

A resumed run writes rows again; dropping repeats within the watermark keeps state bounded by the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1, pattern: str = "*.parquet") -> DataFrame:
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def by_window(events: DataFrame, width: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; windows close once the watermark has passed them."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user, parted by gaps."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_latest(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each user and type in a table, batch by batch: each batch writes a new version beside the old."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("user_id", "event_type", "ts", "event_id", "value")
        if number:
            new = new.unionByName(spark.read.parquet(f"{table_path}/v{number - 1}"))
        last = new.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r")).select("user_id", "event_type", "r.*")
        last.write.mode("overwrite").parquet(f"{table_path}/v{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(rows: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet, and reads that."""
    query = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
