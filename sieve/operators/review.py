"""Review of the riskiest messages, against the same number taken at random (in closed form)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_top(rows: DataFrame, percent: float = 1.0, exclude_base: bool = True, base_count: int | None = None, key: str = "msg_id") -> DataFrame:
    """The k rows of highest risk, equal risks by key: k is that share of the candidates (or of ``base_count``), rounded up."""
    pool = rows.filter(~F.col("base_flag")) if exclude_base else rows
    n = pool.count()
    k = min(n, max(1, math.ceil((base_count or n) * percent / 100.0))) if n else 0
    return pool.orderBy(F.desc("risk"), F.col(key).cast("string")).limit(k)  # k is the feature


def review_lift(rows: DataFrame, percent: float = 1.0, exclude_base: bool = True, base_count: int | None = None, key: str = "msg_id") -> DataFrame:
    """One row: candidates, reviewed, spam found, and for a random choice of as many: mean, standard deviation, lift.

    A random choice without replacement has a hypergeometric count: mean k S / N, variance k p (1 - p) (N - k) / (N - 1).
    """
    pool = rows.filter(~F.col("base_flag")) if exclude_base else rows
    totals = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0)).alias("s"))
    top = review_top(rows, percent, exclude_base, base_count, key)
    found = top.agg(F.count("*").alias("k"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0)).alias("top"))
    n, s, k = F.col("n"), F.col("s"), F.col("k")
    p = s / F.greatest(n, F.lit(1))
    mean = k * p
    var = F.when(n > 1, k * p * (1 - p) * (n - k) / (n - 1)).otherwise(0.0)
    lift = F.when(mean > 1e-12, F.col("top") / mean).when(F.col("top") > 0, F.lit(float("inf"))).otherwise(0.0)
    return totals.crossJoin(found).select(  # one row each
        n.alias("candidates"),
        k.alias("reviewed"),
        F.col("top").cast("long").alias("top_spam"),
        mean.alias("random_mean"),
        F.sqrt(var).alias("random_std"),
        (F.col("top") * 1000.0 / F.greatest(k, F.lit(1))).alias("top_per_1000"),
        (mean * 1000.0 / F.greatest(k, F.lit(1))).alias("random_per_1000"),
        lift.alias("lift"),
    )
