"""Streams over the events table, driven to the end by available-now triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.queries.base import query, table
from sieve.scratch import fresh_path
from sieve.streaming.scoring import dedupe_stream, run_to_files, windowed_counts


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


@query("stream_dedupe", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    out = dedupe_stream(_stream(spark, sf_dir), "event_id", "ts").select("event_id", "user_id", "event_type")
    return run_to_files(out, fresh_path(spark, "deduped"))


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    out = windowed_counts(_stream(spark, sf_dir), "ts", "event_type")
    return run_to_files(out, fresh_path(spark, "hours"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
