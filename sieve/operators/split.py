"""Splits, folds and samples. Orders are explicit or come from hashes, so that every run gives the same rows.

Places inside a bucket are counted by pieces of the order (``prefix.places``), so that no task sorts a whole class or
source. Where only sizes matter, ``hash_share`` splits by hash without any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.operators.prefix import places, slice_of



def _k() -> Column:
    """A row's place in its group, from 1."""
    return F.col("__k")


def _n() -> Column:
    """The size of a row's group."""
    return F.col("__n")


def _hashed(rows: DataFrame, key: str, seed: int | None, by: Sequence[str]) -> DataFrame:
    """Places in order of a hash of the key, equal hashes by the key."""
    digest = F.sha2(F.concat_ws(":", *([] if seed is None else [F.lit(str(seed))]), F.col(key).cast("string")), 256)
    return places(rows.withColumn("__h", digest), by, ("__h", key)).drop("__h")


def chronological_folds(rows: DataFrame, folds: int, order: Sequence[str], by: Sequence[str] = ("y",)) -> DataFrame:
    """fold 0 .. folds-1: equal slices in time for each class, larger ones first."""
    return places(rows, by, order).withColumn("fold", slice_of(_k(), _n(), folds)).drop("__k", "__n")


def source_label_folds(rows: DataFrame, folds: int, date: str, key: str) -> DataFrame:
    """Chronological inside each source and class; equal dates by the hash of the key."""
    marked = rows.withColumn("__h", F.sha2(F.col(key).cast("string"), 256))
    return places(marked, ("source", "y"), (date, "__h")).withColumn("fold", slice_of(_k(), _n(), folds)).drop("__k", "__n", "__h")


def chronological_halves(rows: DataFrame, order: Sequence[str], eras: int = 3) -> DataFrame:
    """half 'fit' for the first floor(n/2) rows of each class, 'gate' for the rest; eras of the rest, else null."""
    first = F.floor(_n() / 2)
    out = places(rows, ("y",), order).withColumn("half", F.when(_k() <= first, "fit").otherwise("gate"))
    return out.withColumn("era", F.when(F.col("half") == "gate", slice_of(_k() - first, _n() - first, eras))).drop("__k", "__n")


def alternating_halves(rows: DataFrame, order: str, by: str = "source") -> DataFrame:
    """half 0 or 1 by turns inside each source."""
    return places(rows, (by,), (order,)).withColumn("half", ((_k() - 1) % 2).cast("int")).drop("__k", "__n")


def recent_split(rows: DataFrame, order: Sequence[str], test: int, val: int) -> DataFrame:
    """For each class the last ``test`` rows are the test, those before them validation, the rest training."""
    out = places(rows, ("y",), order, descending=True)
    return out.withColumn("split", F.when(_k() <= test, "test").when(_k() <= test + val, "val").otherwise("train")).drop("__k", "__n")


def planned_split(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Rows with the split of their plan: (source, y, split, first, last) are places in order of the key's hash, from 1.

    The plan is a configuration table; places join it as a range within equal (source, y).
    """
    placed = _hashed(rows, key, None, ("source", "y"))
    p = plan.select(F.col("source").alias("__s"), F.col("y").alias("__y"), "split", "first", "last")
    on = (F.col("source") == F.col("__s")) & (F.col("y") == F.col("__y")) & _k().between(F.col("first"), F.col("last"))
    return placed.join(F.broadcast(p), on).drop("__s", "__y", "__k", "__n", "first", "last")


def plan_from_fractions(spark, sources: Sequence[tuple[str, int, int]], fractions: Sequence[tuple[str, float]]) -> DataFrame:
    """A plan from (source, y, rows) and (split, share): consecutive ranges, the last split taking what is left."""
    out = []
    for source, y, n in sources:
        at = 1
        for j, (split, share) in enumerate(fractions):
            size = n - at + 1 if j == len(fractions) - 1 else int(n * share)
            out.append((source, y, split, at, at + size - 1))
            at += size
    return spark.createDataFrame(out, "source string, y int, split string, first int, last int")


def plan_shortfalls(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Buckets whose plan needs more rows than there are; must be empty."""
    have = rows.groupBy("source", "y").agg(F.count("*").alias("have"))
    need = plan.groupBy("source", "y").agg(F.max("last").alias("need"))
    return need.join(have, ["source", "y"], "left").fillna(0, ["have"]).filter("have < need")


def leave_one_source_out(rows: DataFrame) -> DataFrame:
    """fold: the place of the row's source among the sorted sources."""
    sources = rows.select("source").distinct().withColumn("fold", F.dense_rank().over(Window.orderBy("source")) - 1)
    return rows.join(F.broadcast(sources), "source")  # a row a source


def fold_classes(rows: DataFrame) -> DataFrame:
    """Folds that lack a class; must be empty."""
    per = rows.groupBy("fold").agg(F.count(F.when(F.col("y") == 1, 1)).alias("spam"), F.count(F.when(F.col("y") == 0, 1)).alias("ham"))
    return per.filter("spam = 0 or ham = 0")


def domain_fold(source: Column, known: dict[str, int], folds: int = 5) -> Column:
    """A fixed fold for known sources; by hash for others."""
    table = F.create_map(*(F.lit(v) for kv in known.items() for v in kv)) if known else F.lit(None).cast("map<string,int>")
    hashed = F.pmod(F.conv(F.substring(F.sha2(source, 256), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    return F.coalesce(F.try_element_at(table, source), hashed)


def hash_share(key: Column, seed: int, parts: int = 1_000_000) -> Column:
    """A number in [0, 1) from a row's key: rows below p are a share of p, in any run and on any partitioning."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(parts)) / F.lit(parts)


def hash_split(rows: DataFrame, key: str, seed: int, train: float, val: float) -> DataFrame:
    u = hash_share(F.col(key), seed)
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def stratified_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows, classes in proportion (each rounded half up, at least 1), in order of hashes."""
    total = rows.agg(F.count("*").alias("__all"))
    want = F.greatest(F.lit(1), F.floor(_n() * most / F.col("__all") + 0.5))
    return _hashed(rows, key, seed, ("y",)).crossJoin(F.broadcast(total)).filter(_k() <= want).drop("__k", "__n", "__all")  # one row


def meta_gate_split(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """For each (y, source) the first half in order of hashes, at least one row, is 'meta', the rest 'gate'."""
    out = _hashed(rows, key, seed, ("y", "source"))
    return out.withColumn("part", F.when(_k() <= F.greatest(F.lit(1), F.floor(_n() / 2)), "meta").otherwise("gate")).drop("__k", "__n")


def holdout(rows: DataFrame, key: str, seed: int, share: float = 0.1, least: int = 32) -> DataFrame:
    """held: for each class round(share * n) rows, at least ``least`` and at most n - 1, in order of hashes."""
    size = F.least(_n() - 1, F.greatest(F.lit(least), F.floor(_n() * share + 0.5)))
    return _hashed(rows, key, seed, ("y",)).withColumn("held", _k() <= size).drop("__k", "__n")


def stratified_folds(rows: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    return _hashed(rows, key, seed, ("y",)).withColumn("fold", F.pmod(_k() - 1, F.lit(folds)).cast("int")).drop("__k", "__n")


def cap_per_bucket(rows: DataFrame, order: str, most: int, by: Sequence[str] = ("source", "y")) -> DataFrame:
    """The first ``most`` rows of each bucket."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__k") <= most).drop("__k")


def lockbox(rows: DataFrame, content: str, most: int) -> DataFrame:
    """For each class the first rows by content hash: a test set that any run selects."""
    return cap_per_bucket(rows, content, most, ("y",))


def external_first(rows: DataFrame, external: Column, content: str, most: int) -> DataFrame:
    """For each class up to ``most`` rows, external ones first, topped up from the others."""
    w = Window.partitionBy("y").orderBy(external.cast("int").desc(), F.col(content))
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most).drop("__k")


def frozen_manifest(rows: DataFrame, split: str = "split", source: str = "source", ordinal: str = "idx") -> DataFrame:
    """ord and file name in each split, in order of the SHA-256 of source:ordinal."""
    digest = F.sha2(F.concat_ws(":", F.col(source), F.col(ordinal).cast("string")), 256)
    out = places(rows.withColumn("__h", digest), (split,), ("__h", source, ordinal)).withColumn("ord", (_k() - 1).cast("int"))
    return out.withColumn("file", F.format_string("%s-%05d.eml", F.col(split), F.col("ord"))).drop("__k", "__n", "__h")


def hard_examples(rows: DataFrame, key: str, seed: int, spam: float = 0.72, ham: float = 0.38, least_spam: int = 1500, least_ham: int = 1200) -> DataFrame:
    """The hardest rows of each class (spam with low scores, ham with high ones), at least so many; ``hard`` marks them."""
    ranked = rows.withColumn("__s", F.when(F.col("y") == 1, F.col("score")).otherwise(-F.col("score")))
    want = F.when(F.col("y") == 1, F.greatest(F.lit(least_spam), F.round(_n() * spam))).otherwise(F.greatest(F.lit(least_ham), F.round(_n() * ham)))
    return places(ranked, ("y",), ("__s", key)).withColumn("hard", _k() <= want).drop("__k", "__n", "__s")

