"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a text (lengths, repetition, symbol shares, character entropy) are transformed to be closer to normal.
Each class gets a mean and a covariance, shrunk towards the pooled covariance and its diagonal; scores are the
difference of the two log densities, computed as squared lengths after multiplying by cached inverse Cholesky factors,
plus the classes' log odds, put through a logistic function.

Fitting needs sums, counts and sums of products of the labelled rows only: they are added up in the tasks, then by class
and place, so the driver receives a table of fixed size, whatever the number of labelled rows (all are used). The
statistics of all texts are computed in place; with the ids they are written once, and labels are joined to that
narrow table.

Defined cases: a null text counts as empty, and an empty text gets a score like any other; labels that aren't 0 or 1,
or belong to no document, are left out; repeated labels and documents count as often as they occur; rows with a null
id are never learned from; if a class has no labelled row, the score of all texts is the share of ones
(0.5 without any labels); an empty table gives an empty result. Labels, language, source and id never enter a
score. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import cut, lean, ship, text_of

FEATURES = (
    "log_words", "mean_word", "sd_word", "log_mean_line", "distinct_words", "top_word", "distinct_pairs", "distinct_lines",
    "upper", "digits", "stops", "symbols", "other_signs", "byte_entropy", "short_words", "high_bytes",
)
_is = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "letter": np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "stop": np.array([b in b".,;:?" for b in range(256)]),
    "symbol": np.array([b in b"#$%&*|<>{}[]=~^_@+/\\" for b in range(256)]),
    "sign": np.array([b in b"!\"'()-`" for b in range(256)]),
    "high": np.array([b >= 128 for b in range(256)]),
}


def _logit(share: float, least: float = 1e-3) -> float:
    p = min(1 - least, max(least, share))
    return math.log(p / (1 - p))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of FEATURES."""
    raw = text.encode("utf-8", "replace")
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256, dtype=np.int64)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, total = len(words), max(1, len(raw))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    mean, sd = (float(sizes.mean()), float(sizes.std())) if n else (0.0, 0.0)
    letters = max(1, int(bytes_[_is["letter"]].sum()))
    p = bytes_[bytes_ > 0] / total
    share = lambda kind, of: float(bytes_[_is[kind]].sum()) / of
    # Distinct words grow as a power of all words; the exponent is what tells varied from repeated text.
    vary = lambda distinct, of: math.log(max(1, distinct)) / math.log(of) if of > 1 else 1.0
    return [
        math.log1p(n),
        math.log1p(mean),
        math.log1p(sd),
        math.log1p(total / max(1, len(lines))),
        vary(len(counts), n),
        _logit(max(counts.values()) / n if n else 0.0),
        vary(len(set(zip(words, words[1:]))), n - 1),
        vary(len(set(lines)), len(lines)),
        _logit(share("upper", letters)),
        _logit(share("digit", total)),
        _logit(share("stop", total)),
        _logit(share("symbol", total)),
        _logit(share("sign", total)),
        float(-(p * np.log(p)).sum()),
        _logit(float((sizes <= 3).sum()) / n if n else 0.0, 1e-2),
        _logit(share("high", total)),
    ]


@dataclass(frozen=True)
class QuadraticModel:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance and half its log determinant."""

    share: float
    classes: tuple | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        density = []
        for prior, mean, whiten, half_log_det in self.classes:
            z = (x - mean) @ whiten.T
            density.append(prior - half_log_det - 0.5 * np.einsum("ij,ij->i", z, z))
        odds = np.clip(density[1] - density[0], -500, 500)
        return 1 / (1 + np.exp(-odds))


def from_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float) -> QuadraticModel:
    """moments: class -> (rows, sum of rows, sum of outer products)."""
    rows = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    total = sum(rows.values())
    if not rows[0] or not rows[1]:
        return QuadraticModel(rows[1] / total if total else 0.5, None)
    means = {k: moments[k][1] / rows[k] for k in (0, 1)}
    scatter = {k: moments[k][2] - rows[k] * np.outer(means[k], means[k]) for k in (0, 1)}
    pooled = (scatter[0] + scatter[1]) / total
    classes = []
    for k in (0, 1):
        cov = (1 - shrink) * scatter[k] / rows[k] + shrink * pooled
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiten = np.linalg.solve(factor, np.eye(len(cov)))
        classes.append((math.log(rows[k] / total), means[k], whiten, float(np.log(np.diag(factor)).sum())))
    return QuadraticModel(rows[1] / total, tuple(classes))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``features``: the statistics of every whole text."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype=np.float64).reshape(-1)
            offsets = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "features"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(lean(run), f"id {kind}, features array<double>").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def fit_quality(
    table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrink: float = 0.05, ridge: float = 1e-3
) -> QuadraticModel:
    """A model from a table of features and the labels of rows that aren't held out."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    marked = marked.filter(F.col("__label").isin(0, 1) & ~held_out("__id"))
    d = len(FEATURES)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for frame in frames:
            x = np.array(frame["features"].tolist(), dtype=np.float64).reshape(-1, d)
            x = np.column_stack([np.ones(len(x)), x])
            for k in (0, 1):
                own = x[frame["__label"].to_numpy() == k]
                found[k] = found.get(k, 0) + own.T @ own
        for k, m in found.items():
            yield pd.DataFrame({"label": k, "place": np.arange(m.size), "value": m.reshape(-1)})

    joined = table.select(F.col(id_col).alias("__own"), "features").join(marked, F.col("__own") == F.col("__id")).select("features", "__label")
    rows = joined.mapInPandas(lean(sums), "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    moments = {}
    for k in (0, 1):
        m = np.zeros((d + 1) * (d + 1))
        for r in rows:
            if r["label"] == k:
                m[r["place"]] = r["value"]
        m = m.reshape(d + 1, d + 1)
        if m[0, 0]:
            moments[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return from_moments(moments, shrink, ridge)


def score_features(table: DataFrame, model: QuadraticModel, id_col: str = "doc_id") -> DataFrame:
    """id and score of a table of features."""
    ship(table.sparkSession)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    base = table.select(F.col(id_col).alias("id"), "features")
    out = base.mapInArrow(lean(run), f"id {base.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)


def score_column(model: QuadraticModel, text_col: str = "text") -> Column:
    """The score as a column over texts, for filtering documents in place."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return score(text_of(text_col))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[QuadraticModel, DataFrame]:
    """The model of these documents and labels, and the documents' features, written once."""
    table = cut(features(docs, id_col, text_col), "quality-features")
    return fit_quality(table, labels, id_col), table


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    model, table = quality_model(docs, labels, id_col, text_col)
    out = score_features(table, model, id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
