"""Streaming: dedupe within a watermark, windowed counts with late data, and scoring by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dedupe_stream(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    out = rows.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def score_stream(messages: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch with a batch plan and writes it under its number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All available input through a stream into Parquet files below a path, read back; nothing passes the driver."""
    out = f"{path}/rows"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:  # each batch holds the whole result
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
