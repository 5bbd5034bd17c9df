"""Scanner replies: lenient and strict parsing, validation with reasons, health, caching, and pluggable scanners.

A scanner is a function from a DataFrame with a binary column ``raw`` to the same rows with ``reply``, a JSON string. The
replay scanner joins recorded replies; the HTTP scanner calls a service from the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.hashing import scan_key
from sieve.schema import SPAM_ACTIONS

SYMBOL_MAP = "map<string, struct<score: string, options: array<string>>>"


class Scanner(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame: ...


def _symbols(reply: Column) -> Column:
    return F.from_json(F.get_json_object(reply, "$.symbols"), SYMBOL_MAP)


def parse_lenient(reply: Column, required: float = 0.0) -> Column:
    """schema.SCAN from a reply: missing text is '', missing numbers 0 (required: a given default); numbers may be strings."""

    def number(path: str, default: float) -> Column:
        return F.coalesce(F.get_json_object(reply, path).try_cast("double"), F.lit(float(default)))

    symbols = F.transform(
        F.map_entries(F.coalesce(_symbols(reply), F.create_map().cast(SYMBOL_MAP))),
        lambda e: F.struct(
            e["key"].alias("name"),
            F.coalesce(e["value"]["score"].try_cast("double"), F.lit(0.0)).alias("score"),
            F.coalesce(e["value"]["options"], F.array().cast("array<string>")).alias("options"),
        ),
    )
    return F.struct(
        F.coalesce(F.get_json_object(reply, "$.action"), F.lit("")).alias("action"),
        number("$.score", 0.0).alias("score"),
        number("$.required_score", required).alias("required"),
        symbols.alias("symbols"),
    )


def strongest_symbols(symbols: Column, most: int = 160) -> Column:
    """By absolute score, then name."""
    keyed = F.transform(symbols, lambda s: F.struct((-F.abs(s["score"])).alias("o"), s["name"].alias("name"), s["score"].alias("score")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score")))


def is_spam_action(action: Column) -> Column:
    return F.lower(F.trim(action)).isin(*SPAM_ACTIONS)


def _json_number(reply: Column, path: str) -> Column:
    """A finite JSON number, or null: strings and booleans don't count."""
    raw = F.get_json_object(reply, path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(reply), path, "variant"))
    value = raw.try_cast("double")
    plain = kind.rlike("^(BIGINT|TINYINT|SMALLINT|INT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(plain & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def validate(reply: Column) -> Column:
    """The reasons why a reply can't be used in an evaluation; empty if it can. Missing scores are errors, not zeros."""
    action = F.get_json_object(reply, "$.action")
    symbols = F.get_json_object(reply, "$.symbols")
    parsed = _symbols(reply)
    rules = [
        ("unreadable", F.try_parse_json(reply).isNull()),
        ("error", F.get_json_object(reply, "$.error").isNotNull()),
        ("skipped", F.lower(F.coalesce(F.get_json_object(reply, "$.is_skipped"), F.lit("false"))) == "true"),
        ("score", _json_number(reply, "$.score").isNull()),
        ("required_score", _json_number(reply, "$.required_score").isNull()),
        ("action", F.coalesce(F.trim(action), F.lit("")) == ""),
        ("deferred", F.coalesce(F.lower(F.trim(action)) == "soft reject", F.lit(False))),
        ("symbols", F.coalesce(~symbols.startswith("{"), F.lit(True))),
        (
            "symbol_score",
            F.coalesce(F.exists(F.map_values(parsed), lambda v: v["score"].try_cast("double").isNull() | F.isnan(v["score"].try_cast("double"))), F.lit(False)),
        ),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)))


def quarantine(rows: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with a usable reply, and the others with their reasons."""
    marked = rows.withColumn("reasons", validate(F.col(reply)))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def health(scans: DataFrame, scan: str = "scan") -> DataFrame:
    """One row: count, lowest and highest score, scans with Bayes symbols, spam actions."""
    s = F.col(scan)
    bayes = F.exists(s["symbols"], lambda x: F.upper(x["name"]).startswith("BAYES"))
    return scans.agg(
        F.count("*").alias("n"),
        F.min(s["score"]).alias("min_score"),
        F.max(s["score"]).alias("max_score"),
        F.coalesce(F.sum(F.when(bayes, 1).otherwise(0)), F.lit(0)).alias("bayes_hits"),
        F.coalesce(F.sum(F.when(is_spam_action(s["action"]), 1).otherwise(0)), F.lit(0)).alias("spam_actions"),
    )


def histograms(scans: DataFrame, scan: str = "scan", most: int = 25) -> DataFrame:
    """(kind, name, n): how often each action occurs, trimmed and in lower case, and the ``most`` most frequent symbols, ties by name."""
    s = F.col(scan)
    actions = scans.groupBy(F.lower(F.trim(s["action"])).alias("name")).agg(F.count("*").alias("n")).select(F.lit("action").alias("kind"), "name", "n")
    symbols = scans.select(F.explode(F.transform(s["symbols"], lambda x: x["name"])).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return actions.unionByName(symbols.orderBy(F.desc("n"), "name").limit(most).select(F.lit("symbol").alias("kind"), "name", "n"))


def require_healthy(scans: DataFrame, scan: str = "scan") -> dict:
    """The health of a batch as a dict; raises if it is empty, all its scores are 0, or no scan has Bayes symbols."""
    row = health(scans, scan).first().asDict()
    if not row["n"]:
        raise ValueError("no scans")
    if row["min_score"] == 0 and row["max_score"] == 0:
        raise ValueError("all scores are 0")
    if not row["bayes_hits"]:
        raise ValueError("no Bayes symbols")
    return row


def learned(reply: Column) -> Column:
    """Whether a learning reply says success without an error."""
    success = F.get_json_object(reply, "$.success")
    return F.coalesce((success == "true") & F.get_json_object(reply, "$.error").isNull(), F.lit(False))


def learning_summary(replies: DataFrame, reply: str = "reply", least: int = 200, share: float = 0.8) -> DataFrame:
    out = replies.agg(F.count("*").alias("n"), F.sum(F.when(learned(F.col(reply)), 1).otherwise(0)).alias("accepted"))
    return out.withColumn("ok", (F.col("accepted") >= least) & (F.col("accepted") >= share * F.col("n")))


def replay_scanner(recorded: DataFrame, namespace: str = "") -> Scanner:
    """A scanner over recorded replies (key, reply), looked up by the scan key."""

    def scan(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__key", scan_key(namespace, F.col("raw"))).join(recorded.select(F.col("key").alias("__key"), "reply"), "__key", "left").drop("__key")

    return scan


def constant_scanner(reply: dict) -> Scanner:
    return lambda rows: rows.withColumn("reply", F.lit(json.dumps(reply)))


def http_scanner(url: str, password: str | None = None, timeout: float = 30.0) -> Scanner:
    """Posts each message to a service from the tasks; failures become replies with an error."""

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.request

        for frame in frames:
            out = []
            for raw in frame["raw"]:
                request = urllib.request.Request(url, data=bytes(raw), headers={"Content-Type": "message/rfc822"} | ({"Password": password} if password else {}))
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as r:
                        out.append(r.read().decode("utf-8", "replace"))
                except OSError as e:
                    out.append(json.dumps({"error": str(e)}))
            yield frame.assign(reply=out)

    def scan(rows: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInPandas(post, f"{fields}, reply string")

    return scan


def cached(rows: DataFrame, cache: DataFrame, scanner: Callable[[DataFrame], DataFrame], namespace: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows with replies, new cache rows): known messages from the cache, the others, each once, from the scanner."""
    keyed = rows.withColumn("key", scan_key(namespace, F.col("raw")))
    known = cache.select("key", "reply")
    missing = keyed.select("key", "raw").join(known, "key", "left_anti").dropDuplicates(["key"])
    fresh = scanner(missing).select("key", "reply")
    return keyed.join(known.unionByName(fresh), "key"), fresh
