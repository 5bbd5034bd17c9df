"""Sample weights: class balance, rules, source balance, mined hardness. All are expressions over counts joined by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _class_counts(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("y").agg(F.count("*").alias("__c"))
    return per.crossJoin(per.agg(F.sum("__c").alias("__all"), F.count("*").alias("__classes")))  # a row a class


def balanced(rows: DataFrame) -> DataFrame:
    """weight = n / (classes * n of the class)."""
    return rows.join(F.broadcast(_class_counts(rows)), "y").withColumn("weight", F.col("__all") / (F.col("__classes") * F.col("__c"))).drop("__c", "__all", "__classes")


def rules(weight: Column, table: Sequence[tuple[Column, float]]) -> Column:
    """A weight multiplied by the factor of each rule that holds."""
    for test, factor in table:
        weight = weight * F.when(test, F.lit(float(factor))).otherwise(F.lit(1.0))
    return weight


def residual_rules(factor: float = 2.5) -> list[tuple[Column, float]]:
    """Spam that the scanner missed weighs more."""
    return [((F.col("y") == 1) & ~F.col("base_flag"), factor)]


def source_balanced(rows: DataFrame) -> DataFrame:
    """Equal mass for each (source, y) inside its class, and for each class: n / (classes * groups of the class * n of the group)."""
    groups = rows.groupBy("source", "y").agg(F.count("*").alias("__g"))
    per = groups.groupBy("y").agg(F.count("*").alias("__groups"))
    total = groups.agg(F.sum("__g").alias("__all"), F.countDistinct("y").alias("__classes"))
    table = groups.join(per, "y").crossJoin(total)  # a row a group
    out = rows.join(F.broadcast(table), ["source", "y"])
    return out.withColumn("weight", F.col("__all") / (F.col("__classes") * F.col("__groups") * F.col("__g"))).drop("__g", "__groups", "__all", "__classes")


def mild_source(rows: DataFrame, low: float = 0.78, high: float = 1.55, ham: float = 1.0) -> DataFrame:
    """weight = sqrt(median group size / group size), clipped; ham by a factor more."""
    groups = rows.groupBy("source", "y").agg(F.count("*").alias("__g"))
    table = groups.crossJoin(groups.agg(F.percentile("__g", 0.5).alias("__m")))  # a row a group
    w = F.greatest(F.lit(low), F.least(F.lit(high), F.sqrt(F.col("__m") / F.col("__g"))))
    out = rows.join(F.broadcast(table), ["source", "y"])
    return out.withColumn("weight", w * F.when(F.col("y") == 0, ham).otherwise(1.0)).drop("__g", "__m")


def hardness(score: Column, y: Column) -> Column:
    return F.when(y == 1, 1 - score).otherwise(score)


def mining_weight(weight: Column, h: Column, y: Column, hard_ham: Column) -> Column:
    """Squared hardness, with steps for hard rows; more for ham."""
    spam = weight * (1 + 7 * h * h) * F.when(h >= 0.65, 1.8).otherwise(1.0)
    ham = weight * (1 + 10 * h * h) * F.when(h >= 0.65, 2.2).otherwise(1.0) * F.when(hard_ham, 1.6).otherwise(1.0)
    return F.when(y == 1, spam).otherwise(ham)


def _class_quantiles(rows: DataFrame, score: str, quantiles: dict[str, tuple[int, float]]) -> DataFrame:
    """One row of exact quantiles: name -> (class, q)."""
    return rows.agg(*(F.percentile(F.when(F.col("y") == y, F.col(score)), q).alias(name) for name, (y, q) in quantiles.items()))


def hard_negative(rows: DataFrame, score: str = "score") -> DataFrame:
    """factor: ham above its 97 % quantile 10, above its 90 % quantile 5, others 1."""
    q = _class_quantiles(rows, score, {"__q97": (0, 0.97), "__q90": (0, 0.90)})
    s = F.col(score)
    f = F.when((F.col("y") == 0) & (s >= F.col("__q97")), 10.0).when((F.col("y") == 0) & (s >= F.col("__q90")), 5.0).otherwise(1.0)
    return rows.crossJoin(F.broadcast(q)).withColumn("factor", f).drop("__q97", "__q90")  # one row


def replay(rows: DataFrame, score: str = "score", ham_top: float = 0.03, spam_bottom: float = 0.2) -> DataFrame:
    """factor: the highest ham 3, the lowest spam 1.8, others 1."""
    q = _class_quantiles(rows, score, {"__h": (0, 1 - ham_top), "__s": (1, spam_bottom)})
    s = F.col(score)
    f = F.when((F.col("y") == 0) & (s >= F.col("__h")), 3.0).when((F.col("y") == 1) & (s <= F.col("__s")), 1.8).otherwise(1.0)
    return rows.crossJoin(F.broadcast(q)).withColumn("factor", f).drop("__h", "__s")


def hard_subset(rows: DataFrame, h: str = "hardness", spam_q: float = 0.45, ham_q: float = 0.55) -> DataFrame:
    """Rows at least as hard as a quantile of their class."""
    q = _class_quantiles(rows, h, {"__s": (1, spam_q), "__h": (0, ham_q)})
    keep = F.when(F.col("y") == 1, F.col(h) >= F.col("__s")).otherwise(F.col(h) >= F.col("__h"))
    return rows.crossJoin(F.broadcast(q)).filter(keep).drop("__s", "__h")


def weight_report(rows: DataFrame, by: Sequence[str] = ("source", "y")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("weight").alias("mass"))


def within_source_share(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("source")
    return rows.withColumn("share", F.col("weight") / F.sum("weight").over(w))
