"""Watermarked windows over a stream of timed events (STM extension of the gap operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.runtime import Workspace


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_activity(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and values of each type by hour; an hour is final once the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("hour"), "event_type", "n", "cents")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, ended by a gap without events."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin_at"), F.col("w.end").alias("end_at"), "n")


def run_once(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What an append-mode stream emits over all that is there now, as a table."""
    space = Workspace(spark, name)
    out, at = f"{space.root}/rows", f"{space.root}/state"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
