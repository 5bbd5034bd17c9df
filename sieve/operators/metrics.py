"""Confusion counts and rates, overall and by group; ranking metrics; threshold curves.

Each is one aggregation with map-side combining. Rates with an empty denominator are null, or the value given as ``empty``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.numeric import ratio
from sieve.operators.prefix import counts_by_score, running_sums


def _count(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")


def tri_state(rows: DataFrame, by: Sequence[str] = (), y: str = "y", decision: str = "decision", base: str = "base_flag") -> DataFrame:
    """Counts of spam/unsure decisions by label, the baseline's counts, and rates (0 where a class is missing)."""
    spam, ham = F.col(y) == 1, F.col(y) == 0
    d = F.col(decision)
    out = rows.groupBy(*by).agg(
        _count(spam).alias("spam_total"),
        _count(ham).alias("ham_total"),
        _count(spam & (d == "Spam")).alias("spam_detected"),
        _count(spam & (d == "Unsure")).alias("spam_unsure"),
        _count(ham & (d == "Spam")).alias("ham_false_positive"),
        _count(ham & (d == "Unsure")).alias("ham_unsure"),
        _count(spam & F.col(base)).alias("base_spam_detected"),
        _count(ham & F.col(base)).alias("base_ham_false_positive"),
    )
    c = F.col
    return out.withColumns(
        {
            "recall": ratio(c("spam_detected"), c("spam_total"), 0),
            "review_coverage": ratio(c("spam_detected") + c("spam_unsure"), c("spam_total"), 0),
            "fpr": ratio(c("ham_false_positive"), c("ham_total"), 0),
            "precision": ratio(c("spam_detected"), c("spam_detected") + c("ham_false_positive"), 0),
            "review_rate": ratio(c("spam_unsure") + c("ham_unsure"), c("spam_total") + c("ham_total"), 0),
            "base_recall": ratio(c("base_spam_detected"), c("spam_total"), 0),
            "base_fpr": ratio(c("base_ham_false_positive"), c("ham_total"), 0),
        }
    )


def confusion(rows: DataFrame, predicted: Column, by: Sequence[str] = (), y: str = "y", empty: float | None = 0.0) -> DataFrame:
    """Binary counts and rates."""
    spam, ham = F.col(y) == 1, F.col(y) == 0
    out = rows.withColumn("__p", predicted).groupBy(*by).agg(
        _count(spam).alias("spam_total"),
        _count(ham).alias("ham_total"),
        _count(spam & F.col("__p")).alias("spam_detected"),
        _count(ham & F.col("__p")).alias("false_positives"),
    )
    return out.withColumns(
        {
            "false_negatives": F.col("spam_total") - F.col("spam_detected"),
            "recall": ratio(F.col("spam_detected"), F.col("spam_total"), empty),
            "precision": ratio(F.col("spam_detected"), F.col("spam_detected") + F.col("false_positives"), empty),
            "fpr": ratio(F.col("false_positives"), F.col("ham_total"), empty),
        }
    )


def with_total(rows: DataFrame, predicted: Column, group: str, y: str = "y", total: str = "*") -> DataFrame:
    """Confusion by group with the total in the same pass (grouping sets)."""
    spam, ham = F.col(y) == 1, F.col(y) == 0
    out = rows.withColumn("__p", predicted).rollup(group).agg(
        F.grouping(group).alias("__all"),
        _count(spam).alias("spam_total"),
        _count(ham).alias("ham_total"),
        _count(spam & F.col("__p")).alias("spam_detected"),
        _count(ham & F.col("__p")).alias("false_positives"),
    )
    named = F.when(F.col("__all") == 1, total).otherwise(F.col(group))
    return out.withColumns(
        {group: named, "recall": ratio(F.col("spam_detected"), F.col("spam_total")), "fpr": ratio(F.col("false_positives"), F.col("ham_total"))}
    ).drop("__all")


def against_baseline(rows: DataFrame, predicted: Column, base: Column, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Counts relative to a baseline or an earlier stage: what is rescued, what false positives are added, F1."""
    spam, ham = F.col(y) == 1, F.col(y) == 0
    out = rows.withColumns({"__p": predicted, "__b": base}).groupBy(*by).agg(
        _count(spam).alias("spam_total"),
        _count(ham).alias("ham_total"),
        _count(spam & F.col("__p")).alias("spam_detected"),
        _count(ham & F.col("__p")).alias("false_positives"),
        _count(spam & F.col("__b")).alias("base_spam_detected"),
        _count(ham & F.col("__b")).alias("base_false_positives"),
        _count(spam & F.col("__p") & ~F.col("__b")).alias("rescued_spam"),
        _count(ham & F.col("__p") & ~F.col("__b")).alias("added_false_positives"),
    )
    both = 2 * F.col("spam_detected")
    return out.withColumn("f1", ratio(both, both + F.col("false_positives") + F.col("spam_total") - F.col("spam_detected"), 0))


def worst_source(rows: DataFrame, predicted: Column, source: str = "source", y: str = "y", least_spam: int = 100) -> DataFrame:
    """Totals and the lowest recall and highest false-positive rate of sources with enough rows of the class."""
    per = confusion(rows, predicted, [source], y, None)
    return per.agg(
        F.sum("spam_total").alias("spam_total"),
        F.sum("ham_total").alias("ham_total"),
        F.sum("spam_detected").alias("spam_detected"),
        F.sum("false_positives").alias("false_positives"),
        F.min(F.when(F.col("spam_total") >= least_spam, F.col("recall"))).alias("worst_recall"),
        F.max(F.when(F.col("ham_total") >= least_spam, F.col("fpr"))).alias("worst_fpr"),
        F.count(F.when(F.col("spam_total") >= least_spam, 1)).alias("counted_sources"),
    )


def slice_recall(rows: DataFrame, predicted: Column, within: Column, y: str = "y") -> DataFrame:
    """Recall of a sub-population."""
    rows = rows.withColumns({"__p": predicted, "__w": within})
    out = rows.agg(_count((F.col(y) == 1) & F.col("__w")).alias("spam_total"), _count((F.col(y) == 1) & F.col("__w") & F.col("__p")).alias("spam_detected"))
    return out.withColumn("recall", ratio(F.col("spam_detected"), F.col("spam_total"), 0))


def roc_auc(scores: DataFrame, by: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """Mann-Whitney with ties sharing their mean rank (scores equal to 12 decimals tie); 0 if a class is missing."""
    counts = counts_by_score(scores.withColumn("score", F.round("score", digits)), by=by)
    run = running_sums(counts, "score", ["pos", "neg"], by, descending=False)
    # Negatives below count fully, those at the same score by half.
    gained = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)
    out = run.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(gained).alias("__won"))
    value = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("__won") / (F.col("positives").cast("double") * F.col("negatives")))
    return out.select(*by, F.coalesce(value, F.lit(0.0)).alias("roc_auc"), "positives", "negatives")


def average_precision(scores: DataFrame, key: str = "msg_id", by: Sequence[str] = ()) -> DataFrame:
    """Sum of the precision at each positive over the positives, in order of score, then key; 0 without positives."""
    marked = scores.withColumns({"__pos": F.when(F.col("y") == 1, 1).otherwise(0), "__one": F.lit(1)})
    order = ["score", key]
    # Unique places: ties in score are ordered by key inside their score's piece.
    counts = marked.groupBy(*by, "score").agg(F.sum("__pos").alias("pos"), F.sum("__one").alias("all"))
    run = running_sums(counts, "score", ["pos", "all"], by)
    before = run.select(*by, "score", (F.col("cum_pos") - F.col("pos")).alias("__p0"), (F.col("cum_all") - F.col("all")).alias("__n0"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "score").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumns({"__p": F.sum("__pos").over(w), "__n": F.sum("__one").over(w)}).join(before, [*by, "score"])
    precision = (F.col("__p0") + F.col("__p")) / (F.col("__n0") + F.col("__n"))
    out = placed.groupBy(*by).agg(F.sum("__pos").alias("positives"), F.sum(F.when(F.col("__pos") == 1, precision)).alias("__s"))
    return out.select(*by, F.coalesce(ratio(F.col("__s"), F.col("positives")), F.lit(0.0)).alias("average_precision"), "positives")


def threshold_curve(scores: DataFrame, steps: int = 100) -> DataFrame:
    """Recall, false-positive rate and precision at thresholds 0, 1/steps, ..., 1; precision is 1 where nothing is predicted.

    Rows fall into the last threshold they reach; a table of steps + 1 rows is summed from the top. No row meets every
    threshold.
    """
    grid = F.floor(F.col("score") * steps).cast("int")
    # The division i / steps decides, not the product: step by one where rounding differs.
    up = (grid + 1).cast("double") / steps <= F.col("score")
    down = grid.cast("double") / steps > F.col("score")
    place = F.when(up, grid + 1).when(down, grid - 1).otherwise(grid)
    counts = scores.withColumn("i", F.least(place, F.lit(steps))).filter("i >= 0").groupBy("i").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg")
    )
    spark = scores.sparkSession
    from pyspark.sql import Window

    grid_rows = spark.range(steps + 1).select(F.col("id").cast("int").alias("i")).join(F.broadcast(counts), "i", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # steps + 1 rows
    totals = scores.agg(_count(F.col("y") == 1).alias("p"), _count(F.col("y") == 0).alias("n"))
    run = grid_rows.select("i", F.sum("pos").over(w).cast("long").alias("tp"), F.sum("neg").over(w).cast("long").alias("fp"))
    run = run.crossJoin(F.broadcast(totals))  # one row
    return run.select(
        (F.col("i").cast("double") / steps).alias("threshold"),
        ratio(F.col("tp"), F.col("p"), 0).alias("recall"),
        ratio(F.col("fp"), F.col("n"), 0).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1).alias("precision"),
        "tp",
        "fp",
    )


def low_fp_recall(scores: DataFrame, share: float = 0.001) -> DataFrame:
    """The highest recall at a threshold with at most max(1, floor(share * ham)) false positives."""
    run = running_sums(counts_by_score(scores), "score", ["pos", "neg"])
    totals = scores.agg(_count(F.col("y") == 1).alias("spam_total"), _count(F.col("y") == 0).alias("ham_total"))
    budget = F.greatest(F.lit(1), F.floor(F.col("ham_total") * share)).cast("long")
    run = run.crossJoin(F.broadcast(totals)).withColumn("budget", budget).filter("cum_neg <= budget")
    best = run.agg(F.max(F.struct("cum_pos", F.col("score").alias("s"), "cum_neg")).alias("b"))
    return best.crossJoin(totals).select(
        F.coalesce(F.col("b.cum_pos"), F.lit(0)).cast("long").alias("spam_detected"),
        F.coalesce(F.col("b.cum_neg"), F.lit(0)).cast("long").alias("false_positives"),
        ratio(F.coalesce(F.col("b.cum_pos"), F.lit(0)), F.col("spam_total"), 0).alias("recall"),
    )


def score_profile(scores: DataFrame, by: Sequence[str] = ("source", "y"), score: str = "score") -> DataFrame:
    """Quantiles and mean of a score by group."""
    p = F.percentile(score, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = scores.groupBy(*by).agg(F.count("*").alias("n"), p.alias("__p"), F.avg(score).alias("mean"))
    return out.select(*by, "n", *(F.col("__p")[k].alias(name) for k, name in enumerate(("p10", "p50", "p90", "p99"))), "mean")
