"""Error analysis: which checks block missed spam, what symbols and shapes errors have, where they lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_bin(c: Column) -> Column:
    """The scanner's score in four bins."""
    return F.when(c <= 0, "<=0").when(c <= 1.5, "0..1.5").when(c <= 3.5, "1.5..3.5").otherwise(">3.5")


def outcome(predicted: Column, y: Column) -> Column:
    return F.when(predicted & (y == 1), "TP").when(predicted, "FP").when(y == 1, "FN").otherwise("TN")


def failed_names(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails (missing values fail), in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, t in checks.items())))


def blockers(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(reason, n): how many rows fail each check."""
    return rows.select(F.explode(failed_names(checks)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def blocker_combinations(rows: DataFrame, checks: dict[str, Column], most: int = 20) -> DataFrame:
    """The most frequent combinations of failed checks; ties by name."""
    combos = rows.select(F.array_join(failed_names(checks), "+").alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n"))
    return combos.orderBy(F.desc("n"), "reasons").limit(most)


def near_and_deep(rows: DataFrame, checks: dict[str, Column], threshold: float) -> DataFrame:
    """One row: missed rows that fail at most two checks, and those far below the threshold."""
    failed = F.size(failed_names(checks))
    return rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.when(failed <= 2, 1).otherwise(0)), F.lit(0)).alias("near_gate"),
        F.coalesce(F.sum(F.when(F.col("score") < 0.35 * threshold, 1).otherwise(0)), F.lit(0)).alias("deep"),
    )


def top_values(rows: DataFrame, value: Column, most: int, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent values with counts and shares of the rows; ties by value."""
    counts = rows.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(most)


def symbol_profile(rows: DataFrame, symbols: str = "symbols", most: int = 25) -> DataFrame:
    """(symbol, n, mean_score, positive, negative): symbols of rows by frequency."""
    each = rows.select(F.explode(symbols).alias("s")).select("s.*")
    out = each.groupBy(F.col("name").alias("symbol")).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("score") < 0, 1).otherwise(0)).alias("negative"),
    )
    return out.orderBy(F.desc("n"), "symbol").limit(most)


def shape(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, and mean, median and 90 % quantile of each column, by group."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.5).alias(f"{c}_p50"), F.percentile(c, 0.9).alias(f"{c}_p90")]
    return rows.groupBy(*by).agg(*aggs)


def source_bin_report(rows: DataFrame, predicted: Column, rscore: str = "rscore") -> DataFrame:
    """(source, bin): rows, misses and false positives."""
    rows = rows.withColumns({"bin": score_bin(F.col(rscore)), "__o": outcome(predicted, F.col("y"))})
    n = lambda v: F.sum(F.when(F.col("__o") == v, 1).otherwise(0)).alias(v.lower())
    return rows.groupBy("source", "bin").agg(F.count("*").alias("n"), n("TP"), n("FP"), n("FN"), n("TN"))


def worst_examples(rows: DataFrame, kind: str, predicted: Column, most: int = 25, key: str = "msg_id") -> DataFrame:
    """The highest-scoring errors of a kind (FN or FP)."""
    wrong = rows.filter(outcome(predicted, F.col("y")) == kind)
    return wrong.orderBy(F.desc("score"), key).limit(most)
