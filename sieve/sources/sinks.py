"""Writers: predictions as CSV or JSON lines, reports, models, frozen splits and scan caches."""

from __future__ import annotations

import io
import json
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.ship import ship

PREDICTION_COLUMNS = ("path", "label", "fingerprint", "decision", "local_probability", "hybrid_risk", "rspamd_spam", "rspamd_action", "rspamd_score", "top_features")


def prediction_lines(rows: DataFrame) -> DataFrame:
    """(line): a CSV line for each row of (path, y, fingerprint, decision, p, risk, base_flag, action, rscore, explanations)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    features = F.array_join(F.transform("explanations", lambda e: F.concat(e["feature"], F.lit(":"), F.format_string("%.4f", e["contribution"]))), " | ")
    parts = [
        quoted(F.col("path")),
        F.when(F.col("y") == 1, "spam").otherwise("ham"),
        F.col("fingerprint"),
        F.col("decision"),
        F.format_string("%.6f", "p"),
        F.format_string("%.6f", "risk"),
        F.when(F.col("base_flag"), "1").otherwise("0"),
        quoted(F.col("action")),
        F.format_string("%.4f", F.coalesce("rscore", F.lit(0.0))),
        quoted(features),
    ]
    return rows.select(F.concat_ws(",", *parts).alias("line"))


def write_prediction_csv(rows: DataFrame, path: str) -> None:
    """Distributed CSV part files without headers; ``prediction_csv`` makes one small file for people."""
    prediction_lines(rows).write.text(path)


def prediction_csv(rows: DataFrame, most: int = 100_000) -> bytes:
    """One CSV with a byte-order mark and a header; for reports, so at most ``most`` rows (more raise)."""
    lines = [r["line"] for r in prediction_lines(rows).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"over {most} rows: use write_prediction_csv")
    out = io.StringIO()
    for line in (",".join(PREDICTION_COLUMNS), *lines):
        out.write(line + "\r\n")
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def write_jsonl(rows: DataFrame, path: str, raw: str = "raw") -> None:
    """A record a message, named by the SHA-256 of its bytes, without its content."""
    (rows.withColumn("id", F.sha2(raw, 256)).drop(raw) if raw in rows.columns else rows).write.json(path)


def report_json(summary: dict, **more) -> str:
    """A report with camel-case keys."""
    camel = lambda k: "".join(p.capitalize() if j else p for j, p in enumerate(k.split("_")))
    return json.dumps({camel(k): v for k, v in (summary | more).items()}, indent=2, sort_keys=True, default=str)


def report_markdown(title: str, rows: list[dict]) -> str:
    """A table of a few result rows; rates as percentages, missing values as a dash."""
    if not rows:
        return f"# {title}\n"
    names = list(rows[0])
    show = lambda v: "—" if v is None else f"{v:.3%}" if isinstance(v, float) and 0 <= v <= 1 else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def save_weights(path: str, settings: dict, weights: DataFrame, fingerprints: DataFrame) -> None:
    """A model folder: settings, weights as float (places with weight 0 left out), and training fingerprints."""
    spark = weights.sparkSession
    spark.createDataFrame([json.dumps(settings)], "string").write.mode("overwrite").text(f"{path}/settings")
    weights.filter("w <> 0").select("idx", F.col("w").cast("float").alias("w")).write.mode("overwrite").parquet(f"{path}/weights")
    fingerprints.write.mode("overwrite").parquet(f"{path}/fingerprints")


def write_frozen_split(rows: DataFrame, path: str) -> None:
    """Rows of a frozen manifest with their bytes, by split."""
    rows.write.partitionBy("split").parquet(path)


def append_cache(fresh: DataFrame, path: str) -> None:
    """New scan replies, by the first two characters of their key; parts appear whole or not at all."""
    fresh.withColumn("prefix", F.substring("key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


MAGIC, VERSION = b"SIEVEMDL", 1  # of the single-file model


def model_bytes(weights: DataFrame, dimension: int, bias: float, spam_threshold: float, ham_threshold: float, exact: DataFrame, near: DataFrame) -> bytes:
    """A model as one file: magic, version, dimension, bias, thresholds, weights as float, and fingerprints of the training rows.

    For models that are carried to one machine: the driver holds ``dimension`` floats and the fingerprints, of which there
    may be at most ten million (more raise). ``save_weights`` writes models of any size.
    """
    most = 10_000_000
    w = np.zeros(dimension, dtype="<f4")
    for r in weights.select("idx", "w").toLocalIterator():
        if not 0 <= r["idx"] < dimension:
            raise ValueError(f"place {r['idx']} is outside the dimension {dimension}")
        w[r["idx"]] = r["w"]
    hashes = sorted(r[0] for r in exact.select("exact").distinct().limit(most + 1).collect())
    marks = sorted(r[0] for r in near.select("simhash").distinct().limit(most + 1).collect())
    if max(len(hashes), len(marks)) > most:
        raise ValueError(f"over {most} fingerprints: use save_weights")
    head = struct.pack("<8siiddd", MAGIC, VERSION, dimension, bias, spam_threshold, ham_threshold)
    tail = struct.pack("<i", len(hashes)) + b"".join(bytes.fromhex(h) for h in hashes) + struct.pack("<i", len(marks)) + np.array(marks, dtype="<i8").tobytes()
    return head + w.tobytes() + tail


def _written(rows: DataFrame, name: str, raw: str, path: str, write) -> DataFrame:
    """(file, size) of what ``write(filesystem, folder, task, files)`` wrote in each task."""
    ship(rows.sparkSession)
    base = rows.select(F.col(name).cast("string").alias("file"), F.col(raw).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        files = ((n, r or b"") for b in batches for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for file, size in write(system, folder, TaskContext.get().partitionId(), files):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64())], ["file", "size"])

    return base.mapInArrow(run, "file string, size long")


def write_messages(rows: DataFrame, path: str, name: str = "file", raw: str = "raw") -> DataFrame:
    """Each row's bytes as a file ``name`` below a folder; (file, size) of those written. Names with '..' or a leading '/' raise."""

    def write(system, folder, _, files):
        for file, content in files:
            if file.startswith("/") or ".." in file.split("/"):
                raise ValueError(f"not below the folder: {file}")
            target = f"{folder}/{file}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write(content)
            yield file, len(content)

    return _written(rows, name, raw, path, write)


def write_archives(rows: DataFrame, path: str, name: str = "file", raw: str = "raw") -> DataFrame:
    """A tar.bz2 archive for each task, streamed; (file, size) of their members."""

    def write(system, folder, task, files):
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/part-{task:05d}.tar.bz2", compression=None) as out, tarfile.open(fileobj=out, mode="w|bz2") as tar:
            for file, content in files:
                info = tarfile.TarInfo(file)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                yield file, len(content)

    return _written(rows, name, raw, path, write)
