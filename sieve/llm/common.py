"""Helpers shared by the operators: shipping code, cutting lineage, column defaults."""

from __future__ import annotations

import ctypes
import functools
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.scratch import fresh_path
from sieve.ship import ship  # noqa: F401  (operators take it from here)

# The white space that separates words in every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lost executors then re-read, never recompute another answer."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """A function over Arrow batches that gives its memory back at its end: workers wait to be used again, and keep what they hold."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
