"""Running sums and places in an order, without one task that sees all rows or all of a group.

Rows are first added up by score. The scores' range is cut at approximate quantiles (a bounded list), sums run inside each
piece, and the pieces' totals, a table of at most ``pieces`` rows, are added in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cuts(df: DataFrame, score: str, pieces: int) -> list[float]:
    at = [k / pieces for k in range(1, pieces)]
    found = df.select(F.percentile_approx(F.col(score), at, F.lit(10_000))).first()[0] or []
    return sorted(set(found))


def running_sums(
    df: DataFrame, score: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = True, pieces: int = 128
) -> DataFrame:
    """``df``, which has a row per (by, score), with cum_x for each x of ``sums``: the sum over this and higher (or lower) scores."""
    cuts = _cuts(df, score, pieces)
    if cuts:
        cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__score", outputCol="__piece", handleInvalid="keep")
        df = cutter.transform(df.withColumn("__score", F.col(score).cast("double"))).drop("__score")
    else:
        df = df.withColumn("__piece", F.lit(0.0))
    by = list(by)
    order = F.col(score).desc() if descending else F.col(score).asc()
    inside = Window.partitionBy(*by, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*by, "__piece").agg(*(F.sum(s).alias(f"__t_{s}") for s in sums))
    ahead = Window.partitionBy(*by).orderBy(F.col("__piece").desc() if descending else F.col("__piece").asc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__piece", *(F.coalesce(F.sum(f"__t_{s}").over(ahead), F.lit(0)).alias(f"__a_{s}") for s in sums))
    df = df.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
    df = df.join(totals if by else F.broadcast(totals), [*by, "__piece"])  # without groups: at most `pieces` rows
    return df.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__a_{s}") for s in sums}).drop("__piece", *(f"__a_{s}" for s in sums))


def counts_by_score(scores: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = (), base: str | None = None) -> DataFrame:
    """(by, score, pos, neg): labelled rows by distinct score; rows with ``base`` set are left out."""
    rows = scores if base is None else scores.filter(~F.col(base))
    return rows.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg")
    )


def _piece(df: DataFrame, first: str, descending: bool, pieces: int) -> Column:
    """A number that never falls along the order of ``first``: rows of a piece are sorted together. Nulls are in the first
    piece (the last if descending), as in the order itself."""
    kind = df.schema[first].dataType.typeName()
    sign = -1.0 if descending else 1.0
    if kind == "string":  # the first two bytes: enough for hashes, where they are uniform
        raw = F.encode(F.col(first), "UTF-8")
        byte = lambda k: F.coalesce(F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("double"), F.lit(-1.0))
        number = F.when(F.col(first).isNotNull(), byte(1) * 257 + byte(2) + 1)
        return F.coalesce(number * sign, F.lit(-1e9 * sign))
    number = (F.datediff(F.col(first), F.lit("1970-01-01")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(first)).cast("double")
    cuts = _cuts(df.select(number.alias("__v")), "__v", pieces)
    place = F.lit(0.0)
    for c in cuts:
        place = place + F.when(number >= c, 1.0).otherwise(0.0)
    return F.when(number.isNull(), F.lit(-1e9 * sign)).otherwise(place * sign)


def places(df: DataFrame, by: Sequence[str], order: Sequence[str], descending: bool = False, pieces: int = 64, prefix: str = "__") -> DataFrame:
    """``df`` with its place k in the order inside each group, from 1, and the group's size n (as ``prefix`` k and n).

    The order is cut into pieces by its first column: places are counted inside a piece, sizes of pieces before it are added. Only
    rows of a group that are equal in that column must be sorted by one task. Equal rows get places in any order, so an order
    should end with a key.
    """
    by = list(by)
    df = df.withColumn("__piece", _piece(df, order[0], descending, pieces))
    inside = Window.partitionBy(*by, "__piece").orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c in order))
    ahead = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, "__piece").agg(F.count("*").alias("__size"))
    sizes = sizes.select(
        *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)),
        F.col("__piece").alias("__at"),
        F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"),
        F.sum("__size").over(Window.partitionBy(*by)).alias(prefix + "n"),
    )
    on = F.col("__piece") == F.col("__at")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    out = df.withColumn(prefix + "k", F.row_number().over(inside)).join(sizes, on)
    return out.withColumn(prefix + "k", F.col(prefix + "k") + F.col("__ahead")).drop("__piece", "__at", "__ahead", *(f"__by{k}" for k in range(len(by))))


def slice_of(k: Column, n: Column, slices: int) -> Column:
    """The slice, from 0, of place k of n: sizes differ by one at most, larger ones first."""
    small, more = F.floor(n / slices), F.pmod(n, F.lit(slices))
    long = more * (small + 1)
    return F.when(k <= long, F.floor((k - 1) / (small + 1))).otherwise(more + F.floor((k - 1 - long) / F.greatest(small, F.lit(1)))).cast("int")
