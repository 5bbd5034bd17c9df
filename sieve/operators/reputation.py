"""Smoothed reputation of entities (senders, domains, campaigns, hosts): tables, lookups, and out-of-fold encoding.

Counts of all entity types are one long table (type, key, spam, total). Out-of-fold counts are totals minus the fold's own, so
every fold is encoded by one aggregation, without a loop; the prior is the fold-excluded one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entity types and the strength of the prior for each.
STRENGTHS = {"sender": 2.0, "sender_domain": 5.0, "return_domain": 5.0, "message_id_domain": 5.0, "ip24": 6.0, "subject": 3.0, "campaign": 4.0, "url_domain": 4.0}


def entities(rows: DataFrame, key: str, columns: dict[str, str], keep: Sequence[str] = ("y",)) -> DataFrame:
    """(key, …, type, entity): a row for each value; array columns give a row for each distinct item; '' and null are left out."""
    kinds = dict(rows.dtypes)
    parts = []
    for name, column in columns.items():
        c = F.col(column)
        items = F.array_distinct(c) if kinds[column].startswith("array") else F.array(c.cast("string"))
        parts.append(_typed(name, items))
    long = rows.select(key, *keep, F.explode(F.concat(*parts)).alias("__e")).select(key, *keep, "__e.*")
    return long.filter("entity is not null and entity <> ''")


def _typed(name: str, items):
    return F.transform(items, lambda v: F.struct(F.lit(name).alias("type"), v.alias("entity")))


def reputation_table(long: DataFrame) -> DataFrame:
    return long.groupBy("type", "entity").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("spam"), F.count("*").alias("total"))


def prior(rows: DataFrame) -> DataFrame:
    """One row: (spam + 1) / (rows + 2)."""
    return rows.agg(((F.sum(F.when(F.col("y") == 1, 1).otherwise(0)) + 1) / (F.count("*") + 2)).alias("prior"))


def _strength():
    table = F.create_map(*(x for k, v in STRENGTHS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.col("type")), F.lit(5.0))


def _encoded(joined: DataFrame) -> DataFrame:
    s, n = F.coalesce("spam", F.lit(0)), F.coalesce("total", F.lit(0))
    return joined.withColumns(
        {
            "rate": (s + _strength() * F.col("prior")) / (n + _strength()),
            "log_count": F.least(F.lit(1.0), F.log1p(n) / 6),
            "unknown": (n == 0).cast("int"),
        }
    )


def lookup(long: DataFrame, table: DataFrame, prior_row: DataFrame, key: str) -> DataFrame:
    """(key, type, entity, rate, log_count, unknown): unknown entities get the prior."""
    out = _encoded(long.join(table, ["type", "entity"], "left").crossJoin(F.broadcast(prior_row)))  # one row
    return out.select(key, "type", "entity", "rate", "log_count", "unknown")


def out_of_fold(rows: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """As lookup, each row seeing only the other folds: rows has (key, y, fold), long has (key, y, fold, type, entity)."""
    spam = F.sum(F.when(F.col("y") == 1, 1).otherwise(0))
    own = long.groupBy("type", "entity", "fold").agg(spam.alias("s"), F.count("*").alias("n"))
    total = own.groupBy("type", "entity").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = own.join(total, ["type", "entity"]).select("type", "entity", "fold", (F.col("ts") - F.col("s")).alias("spam"), (F.col("tn") - F.col("n")).alias("total"))
    per = rows.groupBy("fold").agg(spam.alias("s"), F.count("*").alias("n"))
    all_ = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    priors = per.crossJoin(all_).select("fold", ((F.col("ts") - F.col("s") + 1) / (F.col("tn") - F.col("n") + 2)).alias("prior"))  # a row a fold
    out = _encoded(long.join(rest, ["type", "entity", "fold"], "left").join(F.broadcast(priors), "fold"))
    return out.select(key, "fold", "type", "entity", "rate", "log_count", "unknown")


def reputation_vector(encoded: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """One row a message: for single entities rate, count and unknown; for hosts the highest, mean and lowest rate and their number."""
    aggs = []
    for t in types:
        own = F.col("type") == t
        aggs += [
            F.max(F.when(own, F.col("rate"))).alias(f"{t}_rate"),
            F.max(F.when(own, F.col("log_count"))).alias(f"{t}_log_count"),
            F.max(F.when(own, F.col("unknown"))).alias(f"{t}_unknown"),
        ]
    host = F.col("type") == "url_domain"
    aggs += [
        F.max(F.when(host, F.col("rate"))).alias("url_rate_max"),
        F.avg(F.when(host, F.col("rate"))).alias("url_rate_mean"),
        F.min(F.when(host, F.col("rate"))).alias("url_rate_min"),
        F.count(F.when(host, 1)).alias("url_hosts"),
    ]
    return encoded.groupBy(key).agg(*aggs)
