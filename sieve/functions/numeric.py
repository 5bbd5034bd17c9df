"""Numbers: clipping, logistic functions, ratios, and statistics of a row's array of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def sigmoid(c: Column) -> Column:
    """Stable for large values of either sign."""
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def logit(c: Column, least: float = 1e-6) -> Column:
    p = clip(c, least, 1 - least)
    return F.log(p / (1 - p))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; where b is 0 the given value, or null."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column) -> Column:
    """Population standard deviation."""
    m = array_mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def array_quantile(a: Column, q: float) -> Column:
    """By linear interpolation between sorted values."""
    s, at = F.array_sort(a), F.lit(float(q)) * (F.size(a) - 1)
    low = F.floor(at).cast("int")
    below, above = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(a)))
    return below + (above - below) * (at - low)


def array_geometric(a: Column, least: float = 1e-6) -> Column:
    return F.exp(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x, F.lit(least)))) / F.size(a))


def count_at_least(a: Column, t: float) -> Column:
    return F.size(F.filter(a, lambda x: x >= t))


def top_mean(a: Column, k: int) -> Column:
    return array_mean(F.slice(F.reverse(F.array_sort(a)), 1, k))


def nth_lowest(a: Column, n: int) -> Column:
    return F.element_at(F.array_sort(a), F.least(F.lit(n), F.size(a)))


def array_stats(a: Column, t: float = 0.5) -> list[Column]:
    """The statistics that stacks of experts use, as named columns."""
    return [
        F.array_min(a).alias("low"),
        nth_lowest(a, 2).alias("second_low"),
        array_quantile(a, 0.5).alias("median"),
        array_quantile(a, 0.75).alias("q75"),
        array_mean(a).alias("mean"),
        array_std(a).alias("std"),
        top_mean(a, 3).alias("top3"),
        F.array_max(a).alias("high"),
        count_at_least(a, t).alias("agree"),
    ]
