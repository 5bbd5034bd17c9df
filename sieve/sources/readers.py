"""Readers: folders of messages, labelled pairs, archives, CSV, multi-source tables, manifests, predictions and models."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators.dedupe import keep_first
from sieve.schema import CORPUS


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of all files below a folder that aren't hidden; fails if the folder is missing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter(~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path", F.col("content").alias("raw"))


def labelled_folders(spark: SparkSession, spam: str, ham: str, source: str) -> DataFrame:
    """(path, raw, y, source) of two folders."""
    each = [files_under(spark, p).withColumn("y", F.lit(y)) for p, y in ((spam, 1), (ham, 0))]
    return each[0].unionByName(each[1]).withColumn("source", F.lit(source))


def single_message(spark: SparkSession, raw: bytes) -> DataFrame:
    if not raw:
        raise ValueError("the message is empty")
    return spark.createDataFrame([(bytearray(raw),)], "raw binary")


def archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(archive, path, raw) of the members of tar archives (any compression), hidden files and command lists left out.

    An archive is one task; its members are read one after the other.
    """

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        name = m.name.rsplit("/", 1)[-1]
                        if m.isfile() and not name.startswith(".") and name != "cmds":
                            yield pd.DataFrame({"archive": [path], "path": [m.name], "raw": [tar.extractfile(m).read()]})

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.mapInPandas(members, "archive string, path string, raw binary")


def csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(subject, text, date, y) of a CSV with Spam/Ham, Subject, Message and Date; other labels left out, repeats dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    label = F.lower(F.trim("Spam/Ham"))
    rows = rows.filter(label.isin("spam", "ham")).select(
        F.coalesce("Subject", F.lit("")).alias("subject"),
        F.coalesce("Message", F.lit("")).alias("text"),
        F.coalesce("Date", F.lit("")).alias("date"),
        (label == "spam").cast("int").alias("y"),
    )
    keyed = rows.withColumn("__key", F.sha2(F.concat_ws("\n", F.col("y").cast("string"), F.lower("subject"), F.lower("text")), 256))
    return keyed.dropDuplicates(["__key"]).drop("__key")


def multi_source(spark: SparkSession, path: str) -> DataFrame:
    """Rows of schema.CORPUS: missing text is '', labels other than 0 and 1 are left out."""
    rows = spark.read.schema(CORPUS).parquet(path)
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c, kind in rows.dtypes if kind == "string"}
    return rows.withColumns(texts).filter(F.col("label").isin(0, 1))


ADAPTERS = {
    # How single sources are read. Column expressions over their own columns.
    "phishing_only": {"text": "concat_ws('\\n', Subject, Body)", "y": "1", "where": "NOT contains(coalesce(Body, ''), 'FOLDER INTERNAL DATA') AND NOT contains(lower(coalesce(Body, '')), 'not a real message')"},
    "ham_only": {"text": "output", "y": "0", "where": "output IS NOT NULL"},
    "mixed": {"text": "text", "y": "cast(labels AS int)", "where": "cast(labels AS int) IN (0, 1)"},
    "flagged": {"text": "text", "y": "cast(phishing AS int)", "where": "cast(phishing AS int) IN (0, 1)"},
}


def adapt(rows: DataFrame, kind: str, source: str, least: int = 0) -> DataFrame:
    """(subject, text, y, source) of a source; a subject line in the body is taken out of it. Fails if rows are too few."""
    a = ADAPTERS[kind]
    out = rows.filter(a["where"]).select(F.expr(a["text"]).alias("text"), F.expr(a["y"]).cast("int").alias("y"))
    subject = F.regexp_extract("text", r"(?im)^\s*subject\s*:\s*(.+?)\s*$", 1)
    out = out.select(subject.alias("subject"), "text", "y", F.lit(source).alias("source"))
    if least and out.limit(least).count() < least:
        raise ValueError(f"{source}: fewer than {least} rows")
    return out


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(split, ord, file, y, source) of a JSON manifest."""
    doc = spark.read.schema("version int, train array<struct<file:string,y:int,source:string>>, val array<struct<file:string,y:int,source:string>>, test array<struct<file:string,y:int,source:string>>").json(path, multiLine=True)
    if version is not None and doc.filter(F.col("version") == version).limit(1).count() == 0:
        raise ValueError(f"the manifest's version isn't {version}")
    parts = [doc.select(F.lit(s).alias("split"), F.posexplode(s).alias("ord", "r")).select("split", "ord", "r.*") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prediction records, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def load_weights(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(settings, weights, fingerprints) of a model folder."""
    settings = spark.read.json(f"{path}/settings").first().asDict()
    return settings, spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/fingerprints")


def parse_model(raw: bytes, dimension: int | None = None) -> tuple[dict, np.ndarray, list[str], np.ndarray]:
    """(settings, weights, exact fingerprints, near fingerprints) of a single-file model; another magic, version, dimension or
    length raises."""
    from sieve.sources.sinks import MAGIC, VERSION

    head = struct.calcsize("<8siiddd")
    if len(raw) < head or raw[:8] != MAGIC:
        raise ValueError("not a model file")
    _, version, size, bias, spam, ham = struct.unpack_from("<8siiddd", raw)
    if version != VERSION:
        raise ValueError(f"model version {version}, expected {VERSION}")
    if dimension is not None and size != dimension:
        raise ValueError(f"model dimension {size}, expected {dimension}")
    try:
        weights = np.frombuffer(raw, "<f4", size, head)
        at = head + 4 * size
        (n,) = struct.unpack_from("<i", raw, at)
        exact = [raw[at + 4 + 32 * k : at + 36 + 32 * k].hex() for k in range(n)]
        at += 4 + 32 * n
        (n,) = struct.unpack_from("<i", raw, at)
        near = np.frombuffer(raw, "<i8", n, at + 4)
    except (struct.error, ValueError) as e:
        raise ValueError("the model file is cut off") from e
    if at + 4 + 8 * n != len(raw):
        raise ValueError("the model file is too long")
    return {"dimension": size, "bias": bias, "spam_threshold": spam, "ham_threshold": ham}, weights, exact, near


def corpus_dedupe(rows: DataFrame, key: str, order: str) -> DataFrame:
    return keep_first(rows, key, order)
