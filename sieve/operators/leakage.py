"""Leakage between a training corpus and tests: exact by fingerprint (any letter case), near by banded fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.hashing import hamming
from sieve.operators.fingerprint import bands


def exact_leaks(rows: DataFrame, index: DataFrame, key: str = "exact") -> DataFrame:
    """Rows whose exact fingerprint is in the index."""
    known = index.select(F.lower(key).alias("__k")).distinct()
    return rows.join(known, F.lower(F.col(key)) == F.col("__k"), "left_semi")


def near_leaks(rows: DataFrame, index: DataFrame, most_distance: int = 2, column: str = "simhash") -> DataFrame:
    """Rows whose near fingerprint is within ``most_distance`` bits of one in the index.

    Distinct fingerprints of both sides meet on bands; rows are looked up afterwards.
    """
    own = bands(rows.select(F.col(column).alias("a")).distinct(), "a")
    known = bands(index.select(F.col(column).alias("b")).distinct(), "b")
    close = own.join(known, ["part", "band"]).filter(hamming(F.col("a"), F.col("b")) <= most_distance).select(F.col("a").alias("__a")).distinct()
    return rows.join(close, F.col(column) == F.col("__a"), "left_semi")


def leak_counts(rows: DataFrame, index: DataFrame, key: str, most_distance: int = 2) -> DataFrame:
    """One row: exact leaks, and near leaks that aren't exact ones."""
    exact = exact_leaks(rows, index).select(key, F.lit(1).alias("e"))
    near = near_leaks(rows, index, most_distance).select(key, F.lit(1).alias("n"))
    both = rows.select(key).join(exact, key, "left").join(near, key, "left")
    return both.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("exact_leaks"),
        F.coalesce(F.sum(F.when(F.col("e").isNull(), F.col("n"))), F.lit(0)).alias("near_leaks"),
    )
