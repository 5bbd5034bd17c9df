"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests.

Native: DataFrame functions only.

A URL is expanded only into expressions that a rule could have: suffixes of its host with as many labels
as some rule's host, prefixes of its path as long as some rule's path. The expansion is therefore exact
for any prefix, and its size depends on the rules' shapes, not on the length of the URL. Each expression gets
its SHA-256; the first 32 bits are the join key, the whole digest decides.

Rules of a checked size are broadcast; beyond ``broadcast_rules`` the join shuffles on the hash prefix,
where AQE splits hot prefixes. Only one row for each distinct (id, url) is expanded, and the final aggregation
reuses its partitioning.

Defined cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict;
an empty table gives an empty result; repeated rows are kept, each with the same verdict; of fitting rules with
equally long host and path together the longer host wins, then ``block``. Rules with a null or empty host, or a
null path or verdict, never fit. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) given in code, as literals of the plan; larger sets come as a table."""
    rows = [F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "verdict"), rule))) for rule in rules]
    if not rows:
        return spark.createDataFrame([], "host string, path string, verdict string")
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = 100_000,
) -> DataFrame:
    """id, host, path, rule (host + path of the winning rule, or null) and verdict for every row of ``pages``."""
    rules = (
        rules.filter("host is not null and host <> '' and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("__h"), F.col("path").alias("__p"), F.col("verdict").alias("__v"))
        .distinct()
        .select(
            F.sha2(F.concat_ws("\0", "__h", "__p"), 256).alias("__digest"),
            F.struct(
                (F.length("__h") + F.length("__p")).alias("size"),
                F.length("__h").alias("host_size"),
                (F.col("__v") == "block").alias("block"),
                F.concat("__h", "__p").alias("rule"),
                F.col("__v").alias("verdict"),
            ).alias("__rule"),
            F.size(F.split("__h", r"\.")).alias("__labels"),
            F.length("__p").alias("__path_size"),
        )
    )
    # One row: how many rules there are and the shapes they have, which the length of a URL bounds.
    shape = rules.agg(F.count("*"), F.collect_set("__labels"), F.collect_set("__path_size")).first()
    count, labels, sizes = shape[0], sorted(shape[1]), sorted(shape[2])
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    base = base.groupBy("__id", "__url").agg(F.count("*").alias("__n"))
    base = base.withColumns({"__host": url_host(F.col("__url")), "__path": url_path(F.col("__url"))})
    key = F.substring("__digest", 1, 8)
    right = rules.select(key.alias("__key"), "__digest", "__rule")
    if count <= broadcast_rules:
        right = F.broadcast(right)
    own = F.when(F.col("__host") != "", F.size(F.split("__host", r"\."))).otherwise(0)
    suffixes = F.array_compact(F.array(*(F.when(own >= k, F.substring_index("__host", ".", -k)) for k in labels), F.lit(None).cast("string")))
    prefixes = F.array_compact(
        F.array(*(F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in sizes), F.lit(None).cast("string"))
    )
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\0", h, p), 256))))
    hits = (
        base.withColumn("__own", F.explode_outer(digests))
        .withColumn("__key", F.substring("__own", 1, 8))
        .join(right, "__key", "left")
    )
    best = hits.groupBy("__id", "__url").agg(
        F.first("__n").alias("__n"),
        F.first("__host").alias("host"),
        F.first("__path").alias("path"),
        F.max(F.when(F.col("__own") == F.col("__digest"), F.col("__rule"))).alias("__rule"),
    )
    return best.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", F.lit(default)).alias("verdict"),
    )
