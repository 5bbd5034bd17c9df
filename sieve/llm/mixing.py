"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: all words are shared among the sources by weight; no target exceeds ``cap`` times its source's size, and
the excess is shared again by weight until none does (one level of water for all sources that are not full).

Quotas: the words become seats of ``block`` words. Seats go to sources, and each source's seats to its shards,
by the highest quotients target / (2 k + 1). Shards are pieces of a source of about ``shard_words`` words, at most
``max_shards`` for each source, so that one large source is many tasks, and the apportionment within a source
sees a bounded table.

Selection: a shard's documents are laid end to end in a seeded order. Its quota gives whole passes and a run of blocks
from a seeded place, going round at the end. A document's words taken are those of the passes and the run that are its own:
never above ``cap`` times its size, and the same in every run.

Defined cases: a null text counts as empty and takes 0 words; a null source is a source of its own, last in order;
weights go to sources in code-point order, repeating ``weights``; equal rows are told apart by nothing and share
what their places get; an empty table gives an empty result. Ties of quotients go to the first source, or
shard, in order. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import WORD, cut, ship, text_of


def apportion(targets: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Lague: ``seats`` seats, one by one to the highest target / (2 k + 1); ties to the first.

    Each target gets round(target / d) for a divisor d; a few steps up or down from a first guess of d give the
    same seats as going one by one.
    """
    targets = np.maximum(np.asarray(targets, dtype=float), 0)
    out = np.zeros(len(targets), dtype=np.int64)
    if seats <= 0 or not targets.sum() > 0:
        return out
    low, high = 0.0, 2.0 * targets.sum() / seats + 2 * targets.max()
    for _ in range(200):  # the largest divisor that gives seats or more, from below
        d = (low + high) / 2
        if d in (low, high):
            break
        if np.floor(targets / d + 0.5).sum() >= seats:
            low = d
        else:
            high = d
    out = np.floor(targets / high + 0.5).astype(np.int64)
    while (left := seats - int(out.sum())) > 0:
        quotients = np.where(targets > 0, targets / (2 * out + 1), -1)
        best = np.lexsort((np.arange(len(out)), -quotients))[: min(left, int((targets > 0).sum()))]
        best = best[quotients[best] >= quotients[best[0]] * (1 - 1e-12)]  # equals only: a gain lowers a quotient
        out[best] += 1
    return out


def fill(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Targets: the sum of sizes by weight, none above cap * size."""
    sizes, weights = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    target, full = np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool)
    while True:
        left = sizes.sum() - (cap * sizes[full]).sum()
        open_ = weights[~full].sum()
        target = np.where(full, cap * sizes, left * weights / open_ if open_ > 0 else 0.0)
        over = ~full & (target > cap * sizes)
        if not over.any():
            return target
        full |= over


def _source_quotas(weights: Sequence[float], cap: float, block: int):
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        # Spark has ordered by code point (UTF-8 bytes); nulls last.
        pdf = pdf.assign(n=pdf["__source"].isna()).sort_values(
            ["n", "__source"], key=lambda s: s if s.name == "n" else s.fillna("").map(lambda v: v.encode("utf-8", "surrogatepass"))
        )
        sizes = pdf["__source_size"].to_numpy()
        target = fill(sizes, np.resize(np.asarray(weights, dtype=float), len(pdf)), cap)
        quota = apportion(target, int(round(sizes.sum() / block)))
        return pd.DataFrame({"__source": pdf["__source"], "__source_size": sizes, "__target": target, "__seats": quota})

    return own


def _shard_quotas(cap: float, block: int):
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__shard")
        seats = apportion(pdf["__shard_size"].to_numpy(), int(pdf["__seats"].iloc[0]))
        words = np.minimum(seats * block, (cap * pdf["__shard_size"].to_numpy()).astype(np.int64))
        return pd.DataFrame(
            {c: pdf[c] for c in ("__source", "__source_size", "__target", "__shard", "__shard_size")} | {"__quota": words}
        )

    return own


def _nulls_equal(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    block: int = 16,
    shard_words: int = 1 << 17,
    max_shards: int = 1 << 16,
    seed: int = 20240229,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, copies.

    ``copies``: how many times the mix begins the document; for a mix of whole documents.
    """
    ship(docs.sparkSession)
    base = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("__size"),
    )
    base = cut(base, "mix-sizes")  # words are counted once; all below reads sizes
    sources = base.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    sources = sources.groupBy().applyInPandas(  # one row a source
        _source_quotas(weights, cap, block), "__source string, __source_size long, __target double, __seats long"
    )
    sources = sources.withColumn(
        "__shards", F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("__source_size") / shard_words))).cast("long")
    )
    s = sources.select(F.col("__source").alias("__of"), "__source_size", "__target", "__seats", "__shards")
    place = F.xxhash64(F.lit(seed), "__id", "__size")
    dealt = (
        base.join(s, _nulls_equal("__source", "__of"))
        .withColumn("__place", place)
        .withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed + 1), "__id", "__size"), F.col("__shards")))
        .drop("__of", "__shards")
    )
    shards = (
        dealt.groupBy("__source", "__source_size", "__target", "__seats", "__shard")
        .agg(F.sum("__size").alias("__shard_size"))
        .groupBy("__source")
        .applyInPandas(
            _shard_quotas(cap, block),
            "__source string, __source_size long, __target double, __shard long, __shard_size long, __quota long",
        )
    ).select(F.col("__source").alias("__of"), F.col("__shard").alias("__of_shard"), "__shard_size", "__quota")
    order = Window.partitionBy("__source", "__shard").orderBy("__place", "__id", "__size")
    start = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = dealt.withColumn("__start", start).join(
        shards, _nulls_equal("__source", "__of") & (F.col("__shard") == F.col("__of_shard"))
    )
    size, whole = F.col("__shard_size"), F.greatest(F.col("__shard_size"), F.lit(1))
    passes = F.floor(F.col("__quota") / whole)
    rest = F.col("__quota") - passes * whole
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "__source", "__shard"), F.ceil(whole / F.lit(block))) * block
    end = F.col("__start") + F.col("__size")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, b) - F.greatest(F.col("__start"), a))

    def begins(a: Column, b: Column) -> Column:
        return ((F.col("__start") >= a) & (F.col("__start") < b)).cast("long")

    run = [(first, F.least(first + rest, size)), (F.lit(0).cast("long"), F.greatest(F.lit(0), first + rest - size))]
    taken = passes * F.col("__size") + overlap(*run[0]) + overlap(*run[1])
    copies = passes + begins(*run[0]) + begins(*run[1])
    return laid.select(
        F.col("__id").alias(id_col),
        F.col("__source").alias("source"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        taken.cast("long").alias("taken"),
        copies.cast("long").alias("copies"),
    )
