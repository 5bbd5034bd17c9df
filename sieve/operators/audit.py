"""Audits of frozen splits: counts, labels, paths, content shared within or across splits, and ordered digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_problems(rows: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """(problem, detail): empty if a manifest (schema.MANIFEST) is sound."""
    spark = rows.sparkSession
    bad_label = rows.filter(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).select(F.lit("label").alias("problem"), F.col("file").alias("detail"))
    escape = rows.filter(F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)")).select(F.lit("path").alias("problem"), F.col("file").alias("detail"))
    per = rows.groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    within = per.filter("n > 1 and splits = 1").select(F.lit("repeated within a split").alias("problem"), F.col("sha256").alias("detail"))
    across = per.filter("splits > 1").select(F.lit("shared by splits").alias("problem"), F.col("sha256").alias("detail"))
    out = bad_label.unionByName(escape).unionByName(within).unionByName(across)
    if expected:
        want = spark.createDataFrame(list(expected.items()), "split string, want long")
        have = rows.groupBy("split").agg(F.count("*").alias("have"))
        counts = want.join(have, "split", "full_outer").fillna(0, ["want", "have"]).filter("want <> have")
        out = out.unionByName(counts.select(F.lit("count").alias("problem"), F.concat_ws(":", "split", "have", "want").alias("detail")))
    return out


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of a manifest that aren't in a listing: all are looked up, not the first few."""
    return manifest.join(listing.select(F.col("path").alias("file")), "file", "left_anti").select("split", "file")


def split_digest(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """(split, n, digest): SHA-256 over lines in order, in two levels, so that no group holds a whole split.

    Lines are hashed by blocks of consecutive places; the digest is the SHA-256 of the blocks' digests in order.
    """
    line = F.to_json(F.struct("file", "sha256", F.col("y").alias("label"), "source"))
    rows = manifest.select("split", F.col("ord"), F.floor(F.col("ord") / block).alias("block"), line.alias("line"))
    ordered = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda s: s[v]), "\n")
    blocks = rows.groupBy("split", "block").agg(F.count("*").alias("n"), F.sha2(ordered("ord", "line"), 256).alias("d"))
    return blocks.groupBy("split").agg(F.sum("n").alias("n"), F.sha2(ordered("block", "d"), 256).alias("digest"))


def require(problems: DataFrame) -> None:
    first = problems.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r['problem']}: {r['detail']}" for r in first))


def class_guard(rows: DataFrame, sizes: dict[str, int] | None = None) -> None:
    """Raises if a class is missing, or a split hasn't its size."""
    classes = {r["y"] for r in rows.select("y").distinct().limit(3).collect()}
    if classes != {0, 1}:
        raise ValueError(f"classes: {sorted(classes)}")
    if sizes:
        have = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # a row a split
        if have != sizes:
            raise ValueError(f"sizes: {have}, expected {sizes}")
