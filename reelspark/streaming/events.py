"""Windows over the event stream (an addition of this library): tumbling and session windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def session_windows(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is and gives its last (complete) or added rows as a table."""
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    write = "overwrite" if mode == "complete" else "append"
    # with timeouts in processing time there is always another batch, so such a stream takes all there is as one
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    run = run.trigger(availableNow=True) if mode == "complete" else run.trigger(once=True)
    run.foreachBatch(lambda df, _: df.write.mode(write).parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
