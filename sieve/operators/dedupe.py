"""Dedupe policies by content key: keep the first, drop all copies, drop conflicts; and set operations against other corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the first in order: a minimum with map-side combining and a join, safe for hot keys."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    return rows.join(first.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__first"))).drop("__key", "__first")


def key_stats(rows: DataFrame, key: str, y: str = "y") -> DataFrame:
    """(key, n, labels, conflict): how often a key occurs and with how many labels."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(y).alias("labels"))
    return out.withColumn("conflict", F.col("labels") > 1)


def drop_all(rows: DataFrame, key: str) -> DataFrame:
    """Only rows whose key occurs once."""
    once = rows.groupBy(key).agg(F.count("*").alias("__n")).filter("__n = 1").select(key)
    return rows.join(once, key, "left_semi")


def drop_conflicts(rows: DataFrame, key: str, order: str, y: str = "y") -> DataFrame:
    """Keys with more than one label go altogether; of the others the first row stays."""
    good = key_stats(rows, key, y).filter(~F.col("conflict")).select(key)
    return keep_first(rows.join(good, key, "left_semi"), key, order)


def removal_report(rows: DataFrame, key: str, y: str = "y") -> DataFrame:
    """One row: rows, keys, rows lost to conflicting keys, and to repeats of other keys."""
    s = key_stats(rows, key, y)
    return s.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("keys"),
        F.sum(F.when(F.col("conflict"), F.col("n")).otherwise(0)).alias("conflict_rows"),
        F.sum(F.when(F.col("conflict"), 0).otherwise(F.col("n") - 1)).alias("repeated_rows"),
    )


def not_in(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a prior corpus."""
    return rows.join(blocked.select(key).distinct(), key, "left_anti")


def overlapping_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split; must be empty."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def union_all(*corpora: DataFrame) -> DataFrame:
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
