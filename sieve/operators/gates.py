"""Threshold and gate search under false-positive budgets.

One-dimensional searches sum counts from the highest score down. Searches over several conditions first count rows in the
cells of their grids (every condition's grid is small and fixed), then sum the cells; candidates never meet rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.numeric import ratio
from sieve.operators.prefix import counts_by_score, running_sums
from sieve.schema import NOTHING


def _totals(scores: DataFrame) -> DataFrame:
    n = lambda t: F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).cast("long")
    b, y = F.col("base_flag"), F.col("y")
    return scores.agg(
        n(y == 1).alias("spam_total"), n(y == 0).alias("ham_total"), n((y == 1) & b).alias("base_tp"), n((y == 0) & b).alias("base_fp")
    )


def candidates(scores: DataFrame) -> DataFrame:
    """A row for each threshold worth trying, and one that selects nothing: threshold, tp, fp (baseline included), totals, rates."""
    clamped = scores.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    # All distinct scores are candidates; rows that the baseline has already add nothing to the counts.
    counts = clamped.groupBy("score").agg(
        F.sum(F.when((F.col("y") == 1) & ~F.col("base_flag"), 1).otherwise(0)).alias("pos"),
        F.sum(F.when((F.col("y") == 0) & ~F.col("base_flag"), 1).otherwise(0)).alias("neg"),
    )
    run = running_sums(counts, "score", ["pos", "neg"]).select(F.col("score").alias("threshold"), "cum_pos", "cum_neg")
    none = scores.sparkSession.range(1).select(F.lit(NOTHING).alias("threshold"), F.lit(0).cast("long").alias("cum_pos"), F.lit(0).cast("long").alias("cum_neg"))
    out = run.unionByName(none).crossJoin(F.broadcast(_totals(scores)))  # one row
    out = out.withColumns({"tp": F.col("base_tp") + F.col("cum_pos"), "fp": F.col("base_fp") + F.col("cum_neg")})
    return out.withColumns(
        {
            "recall": ratio(F.col("tp"), F.col("spam_total"), 0),
            "fpr": ratio(F.col("fp"), F.col("ham_total"), 0),
            "added_fp": F.col("cum_neg"),
        }
    ).drop("cum_pos", "cum_neg")


def _best(found: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The row with the largest keys, in order."""
    return found.orderBy(*(k.desc() for k in keys)).limit(1)


def threshold_under_fpr(scores: DataFrame, most_fpr: float = 0.005) -> DataFrame:
    """The threshold with the highest recall, then the lowest rate, then the highest value, whose false-positive rate is allowed;
    if none is, the one that leaves the baseline alone."""
    c = candidates(scores).withColumn("feasible", F.col("fpr") <= most_fpr + 1e-12)
    # Counts in place of rates compare without rounding.
    keys = [F.col("feasible"), F.when(F.col("feasible"), F.col("tp")), F.when(F.col("feasible"), -F.col("fp")), F.col("threshold")]
    return _best(c, keys).select("threshold", "recall", "fpr", "tp", "fp", "feasible")


def threshold_under_added_fp(scores: DataFrame, most_added: int) -> DataFrame:
    """As above with a budget of false positives added to the baseline's."""
    c = candidates(scores).filter(F.col("added_fp") <= most_added)
    return _best(c, [F.col("tp"), -F.col("fp"), F.col("threshold")]).select("threshold", "recall", "fpr", "tp", "fp", "added_fp")


def budgeted_and_target(scores: DataFrame, share: float = 0.005, target: float = 0.9) -> DataFrame:
    """Two points: the best under a budget of base_fp + max(1, floor(ham * share)), and the fewest false positives with the target recall."""
    c = candidates(scores)
    budget = F.col("base_fp") + F.greatest(F.lit(1), F.floor(F.col("ham_total") * share))
    first = _best(c.filter(F.col("fp") <= budget), [F.col("tp"), -F.col("fp"), F.col("threshold")]).withColumn("point", F.lit("budget"))
    second = _best(c.filter(F.col("recall") >= target), [-F.col("fp"), F.col("tp"), F.col("threshold")]).withColumn("point", F.lit("target"))
    return first.unionByName(second).select("point", "threshold", "recall", "fpr", "tp", "fp")


def threshold_worst_source(scores: DataFrame, share: float = 0.004, least_spam: int = 20, grid: int = 200) -> DataFrame:
    """Over a grid of thresholds under a false-positive budget: the one whose worst source is best, then recall, then fewer false positives.

    Rows are counted by source and grid cell, then summed down the grid in each source.
    """
    cell = F.least(F.lit(grid), F.greatest(F.lit(0), F.floor(F.col("score") * grid))).cast("int")
    counts = scores.withColumn("i", cell).groupBy("source", "i").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg")
    )
    sources = counts.groupBy("source").agg(F.sum("pos").alias("spam"), F.sum("neg").alias("ham"))
    full = sources.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid)))).join(counts, ["source", "i"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy("source").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    run = full.select("source", "i", "spam", "ham", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    per = run.groupBy("i").agg(
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("spam").alias("spam"),
        F.sum("ham").alias("ham"),
        F.coalesce(F.min(F.when(F.col("spam") >= least_spam, F.col("tp") / F.col("spam"))), F.lit(0.0)).alias("worst_recall"),
    )
    allowed = per.filter(F.col("fp") <= F.greatest(F.lit(1), F.floor(F.col("ham") * share)))
    best = _best(allowed, [F.round("worst_recall", 12), F.col("tp"), -F.col("fp"), F.col("i")])
    return best.select((F.col("i") / grid).alias("threshold"), "tp", "fp", "worst_recall", ratio(F.col("tp"), F.col("spam"), 0).alias("recall"))


# -- gates over several conditions --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Axis:
    """A condition of a gate: ``column >= limit`` (rising) or ``column <= limit``, for each limit of a grid."""

    column: str
    limits: tuple[float, ...]
    rising: bool = True

    def cell(self) -> Column:
        """How many of the limits, from the loosest on, a row satisfies."""
        ordered = sorted(self.limits, reverse=not self.rising)
        test = [F.col(self.column) >= F.lit(v) if self.rising else F.col(self.column) <= F.lit(v) for v in ordered]
        total = F.lit(0)
        for t in test:
            total = total + F.when(t, 1).otherwise(0)
        return total

    def ordered(self) -> list[float]:
        return sorted(self.limits, reverse=not self.rising)


def _grid(spark, axes: Sequence[Axis]) -> DataFrame:
    """Every combination of limits: place of each in its axis (1 is the loosest), and the limits themselves."""
    out = spark.range(1).select(F.lit(1).alias("__one"))
    for k, axis in enumerate(axes):
        pairs = F.array(*(F.struct(F.lit(j + 1).alias("at"), F.lit(float(v)).alias("limit")) for j, v in enumerate(axis.ordered())))
        out = out.withColumn("__x", F.explode(pairs)).select("*", F.col("__x.at").alias(f"k{k}"), F.col("__x.limit").alias(axis.column)).drop("__x")
    return out.drop("__one")


def gate_counts(scores: DataFrame, axes: Sequence[Axis], by: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """For every gate of the grid (all conditions hold), and group: tp and fp of the rows that pass.

    Rows are counted by cell, and cells are summed along each axis in turn (from the tightest limit to the loosest),
    so the work after the first aggregation depends on the grid alone.
    """
    rows = scores if only is None else scores.filter(only)
    names = [f"k{k}" for k in range(len(axes))]
    cells = rows.select(*by, "y", *(a.cell().alias(n) for a, n in zip(axes, names)))
    cells = cells.groupBy(*by, *names).agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("fp")
    )
    # A row in cell c passes limits 1..c of an axis: add each cell to those places, one axis at a time.
    for n in names:
        keys = [*by, *names]
        cells = cells.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
        cells = cells.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    grid = _grid(scores.sparkSession, axes)
    if by:
        grid = scores.select(*by).distinct().crossJoin(F.broadcast(grid))  # groups, not rows, meet the grid
    return grid.join(cells, [*by, *names], "left").fillna(0, ["tp", "fp"]).select(*by, *(a.column for a in axes), "tp", "fp")


def best_gate(
    scores: DataFrame, axes: Sequence[Axis], most_fp: int, fold: str | None = None, most_fold_fp: int | None = None, only: Column | None = None
) -> DataFrame:
    """The gate with the most hits under a budget of false positives, overall and (if asked) in each fold;
    ties: fewer false positives, then tighter limits."""
    columns = [a.column for a in axes]
    if fold:
        per = gate_counts(scores, axes, [fold], only)
        total = per.groupBy(*columns).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.max("fp").alias("worst_fold_fp"))
        if most_fold_fp is not None:
            total = total.filter(F.col("worst_fold_fp") <= most_fold_fp)
    else:
        total = gate_counts(scores, axes, (), only)
    tight = [F.col(a.column) if a.rising else -F.col(a.column) for a in axes]
    return _best(total.filter(F.col("fp") <= most_fp), [F.col("tp"), -F.col("fp"), *tight])


def guard_to_target(scores: DataFrame, axes: Sequence[Axis], most_fp: int, target_tp: int) -> DataFrame:
    """If a gate under the budget reaches the target, the one with the fewest false positives; else the one with the most hits."""
    total = gate_counts(scores, axes).filter(F.col("fp") <= most_fp).withColumn("reached", F.col("tp") >= target_tp)
    tight = [F.col(a.column) if a.rising else -F.col(a.column) for a in axes]
    keys = [F.col("reached"), F.when(F.col("reached"), -F.col("fp")).otherwise(F.col("tp")), F.when(F.col("reached"), F.col("tp")).otherwise(-F.col("fp")), *tight]
    return _best(total, keys)


def two_tier(scores: DataFrame, axes: Sequence[Axis], most_fp: int, tier_fp: int) -> DataFrame:
    """The pair of gates, primary or override, with the most hits together under a budget.

    Tiers over ``tier_fp`` are pruned first. |P or O| = |P| + |O| - |P and O|, and both together are one gate of the
    same grid: the tighter limit on each axis. So pairs are looked up, not evaluated over rows.
    """
    columns = [a.column for a in axes]
    all_gates = gate_counts(scores, axes)
    tiers = all_gates.filter(F.col("fp") <= tier_fp)
    p = tiers.select(*(F.col(c).alias(f"p_{c}") for c in columns), F.col("tp").alias("p_tp"), F.col("fp").alias("p_fp"))
    o = tiers.select(*(F.col(c).alias(f"o_{c}") for c in columns), F.col("tp").alias("o_tp"), F.col("fp").alias("o_fp"))
    less = F.array(*(F.col(f"p_{c}") for c in columns)) <= F.array(*(F.col(f"o_{c}") for c in columns))
    pairs = p.crossJoin(F.broadcast(o)).filter(less)  # gates of a fixed grid, not rows
    for a in axes:
        pick = F.greatest if a.rising else F.least
        pairs = pairs.withColumn(a.column, pick(f"p_{a.column}", f"o_{a.column}"))
    both = F.broadcast(all_gates.select(*columns, F.col("tp").alias("b_tp"), F.col("fp").alias("b_fp")))
    pairs = pairs.join(both, columns).withColumns({"tp": F.expr("p_tp + o_tp - b_tp"), "fp": F.expr("p_fp + o_fp - b_fp")})
    keys = [F.col("tp"), -F.col("fp"), *(F.col(f"p_{c}") for c in columns), *(F.col(f"o_{c}") for c in columns)]
    return _best(pairs.filter(F.col("fp") <= most_fp), keys).select(
        *(f"p_{c}" for c in columns), *(f"o_{c}" for c in columns), "tp", "fp"
    )


def failed_checks(checks: dict[str, Column]) -> Column:
    """How many checks a row fails (a missing value fails)."""
    total = F.lit(0)
    for test in checks.values():
        total = total + F.when(test, 0).otherwise(1)
    return total


def precision_guard(scores: DataFrame, within: Column, margin: float = 1e-6) -> DataFrame:
    """A threshold above every ham in a sub-population, and what it selects there."""
    rows = scores.filter(within)
    ceiling = rows.agg((F.coalesce(F.max(F.when(F.col("y") == 0, F.col("score"))), F.lit(0.0)) + margin).alias("threshold"))
    return rows.crossJoin(F.broadcast(ceiling)).groupBy("threshold").agg(  # one row
        F.coalesce(F.sum(F.when((F.col("y") == 1) & (F.col("score") >= F.col("threshold")), 1).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when((F.col("y") == 0) & (F.col("score") >= F.col("threshold")), 1).otherwise(0)), F.lit(0)).alias("fp"),
    )


def anchored_gates(scores: DataFrame, axes: Sequence[Axis], relax: Sequence[float] = (1.0, 0.97, 0.92, 0.85), digits: int = 7) -> DataFrame:
    """Gates made from missed spam: each row's values, loosened by each factor, without repeats."""
    missed = scores.filter((F.col("y") == 1) & ~F.col("base_flag"))
    rows = missed.withColumn("__r", F.explode(F.array(*map(F.lit, relax))))
    limit = lambda a: F.col(a.column) * F.col("__r") if a.rising else 1 - (1 - F.col(a.column)) * F.col("__r")
    return rows.select(*(F.round(limit(a), digits).alias(a.column) for a in axes)).dropDuplicates()


@dataclass(frozen=True)
class Profile:
    """Budgets and targets by name: the only place where a search takes them from."""

    name: str
    most_fp: int
    most_fold_fp: int
    target_recall: float


PROFILES = (Profile("safe", 3, 1, 0.7), Profile("balanced", 16, 4, 0.9), Profile("target", 100, 25, 0.95))


def pareto(points: DataFrame, profiles: Sequence[tuple[str, float, float]], key: Sequence[Column], fallback: Sequence[Column]) -> DataFrame:
    """For each profile (name, highest fpr, highest worst fpr): the best allowed point, or by ``fallback`` if none is allowed."""
    table = F.array(*(F.struct(F.lit(n).alias("profile"), F.lit(f).alias("most_fpr"), F.lit(w).alias("most_worst")) for n, f, w in profiles))
    rows = points.withColumn("__p", F.explode(table)).select("*", "__p.*").drop("__p")
    rows = rows.withColumn("allowed", (F.col("fpr") <= F.col("most_fpr")) & (F.col("worst_fpr") <= F.col("most_worst")))
    order = [F.col("allowed").desc()] + [F.when(F.col("allowed"), k).desc_nulls_last() for k in key] + [F.when(~F.col("allowed"), k).desc_nulls_last() for k in fallback]
    w = Window.partitionBy("profile").orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "most_fpr", "most_worst")
