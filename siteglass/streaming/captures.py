"""Incremental captures: the daily latest position of each pair from a stream of snapshots.

An extension beyond batch captures. Late snapshots count until the watermark passes their day; repeated
ones are dropped by their id. The batch aggregate over the same rows is the reference result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def positions(events: DataFrame) -> DataFrame:
    position = F.least(F.lit(100), F.greatest(F.lit(1), F.floor(F.col("value") + 0.5))).cast("int")
    return events.select("event_id", F.col("user_id").alias("page_no"), F.col("event_type").alias("keyword"), F.col("ts").cast("timestamp").alias("ts"), position.alias("position"))


def daily_latest(snapshots: DataFrame, late: str | None = "2 days") -> DataFrame:
    """page_no, keyword, day, position (the day's last), points; with a watermark if it is a stream."""
    rows = snapshots.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if late and snapshots.isStreaming else snapshots.dropDuplicates(["event_id"])
    day = F.window("ts", "1 day")
    out = rows.groupBy("page_no", "keyword", day.alias("w")).agg(F.max_by("position", F.struct("ts", "event_id")).alias("position"), F.count(F.lit(1)).alias("points"))
    return out.select("page_no", "keyword", F.to_date("w.start").alias("day"), "position", "points")


def stream(spark: SparkSession, folder: str, checkpoint: str, out: str) -> StreamingQuery:
    """Runs over the folder's Parquet files once, and appends days that the watermark has closed."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(folder)
    return daily_latest(positions(events)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
