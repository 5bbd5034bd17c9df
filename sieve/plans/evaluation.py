"""The evaluation of scored messages: metrics overall and by source, ranking, review lift and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators import gates, metrics, review
from sieve.sources.sinks import report_json, report_markdown


def evaluate(scores: DataFrame, threshold: float, percent: float = 1.0) -> dict:
    """A summary of a few numbers; every number is an aggregate over all rows."""
    predicted = F.col("base_flag") | (F.col("score") >= threshold)
    summary = metrics.against_baseline(scores, predicted, F.col("base_flag")).first().asDict()
    summary |= metrics.roc_auc(scores).select("roc_auc").first().asDict()
    summary |= metrics.average_precision(scores).select("average_precision").first().asDict()
    summary |= metrics.worst_source(scores, predicted).select("worst_recall", "worst_fpr").first().asDict()
    summary |= review.review_lift(scores.withColumn("risk", F.col("score")), percent).first().asDict()
    return summary | {"threshold": threshold}


def report(scores: DataFrame, most_fpr: float = 0.005) -> tuple[str, str]:
    """(JSON, Markdown) of an evaluation at the best threshold under a rate."""
    best = gates.threshold_under_fpr(scores, most_fpr).first()
    summary = evaluate(scores, best["threshold"])
    by_source = metrics.with_total(scores, F.col("base_flag") | (F.col("score") >= best["threshold"]), "source").orderBy("source")
    rows = [r.asDict() for r in by_source.limit(1000).collect()]  # a row a source
    return report_json(summary), report_markdown("Evaluation", rows)


def two_models(scores: DataFrame, first: str, second: str, threshold: float) -> DataFrame:
    """Standalone and combined accounting of two models, in one pass."""
    a, b = F.col(first) >= threshold, F.col(second) >= threshold
    rows = scores.withColumns({"__a": a, "__b": b})
    n = lambda t: F.sum(F.when(t, 1).otherwise(0))
    y1, y0 = F.col("y") == 1, F.col("y") == 0
    return rows.agg(
        n(y1 & F.col("__a")).alias("first_tp"),
        n(y0 & F.col("__a")).alias("first_fp"),
        n(y1 & F.col("__b")).alias("second_tp"),
        n(y0 & F.col("__b")).alias("second_fp"),
        n(y1 & (F.col("__a") | F.col("__b"))).alias("either_tp"),
        n(y0 & (F.col("__a") | F.col("__b"))).alias("either_fp"),
        n(y1 & F.col("__b") & ~F.col("__a")).alias("rescued"),
    )
