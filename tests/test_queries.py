"""Registered queries do the whole of their operators' work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, NGram, Normalizer, VectorAssembler
from pyspark.sql import functions as F

from sieve.functions import text as X
from sieve.operators import experts, features, split
from sieve.queries import models, scored, text


def test_model_queries_are_not_shrunk(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 2, f"some words {k}", "s") for k in range(10)], "doc_id long, y int, text string, source string")
    monkeypatch.setattr(models, "messages", lambda *_: rows)
    asked = {}
    for name in ("logistic", "linear_svm", "complement_bayes"):
        monkeypatch.setattr(experts, name, lambda name=name, **given: asked.setdefault(name, []).append(given))
    monkeypatch.setattr(experts, "cross_fit", lambda rows, fit, folds, output: asked.setdefault("folds", []).append(folds) or rows.withColumn(output, rows["y"] * 1.0))
    monkeypatch.setattr(experts, "boosted", lambda **given: 1 / 0 if given["rounds"] < 180 else None)
    assert models._rows(spark, "").first()["features"].size == (1 << 18) + (1 << 17)
    for name in ("nb_complement", "svc_sigmoid"):
        models.query.__globals__["QUERIES"][name](spark, "")
    assert asked["folds"] == [5, 5] and asked["linear_svm"] == [{"iterations": 50}]


def test_char_ngrams_have_three_sizes(spark, tmp_path):
    spark.createDataFrame([(1, "abc Abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["gram"]: r["n"] for r in text.char_ngrams(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys([" ab", "abc", "bc ", " abc", "abc ", " abc "], 2)


def test_manifest_names_of_six_digits(spark, monkeypatch):
    rows = spark.range(134_000).select(F.col("id").alias("msg_id"), F.lit("s").alias("source"))
    monkeypatch.setattr(scored, "scores", lambda *_: rows)
    got = {r["ord"]: r["file"] for r in scored.frozen_manifest(spark, "").filter("split = 'train'").collect()}
    assert len(got) == 100_500
    assert got[7] == "train-00007.eml" and got[100_321] == "train-10032.eml"  # as the SQL's lpad has it
    own = split.frozen_manifest(rows.withColumn("split", F.lit("train")), ordinal="msg_id")
    assert own.select("file").distinct().count() == 134_000  # the operator's names stay whole


def test_byte_windows_return_few_at_a_time(spark):
    parts = list(features._byte_codes(pa.array([b"ab", None] * 500), 8))
    assert [len(p) for p in parts] == [256, 256, 256, 232] and parts[0][0].as_py() == [98, 99, 0, 0, 0, 0, 0, 0]
    rows = spark.createDataFrame([(0, b"\x00\xff"), (1, None), (2, b""), (3, bytes(range(256)) * 20)], "k int, b binary").repartition(1)
    got = dict(rows.select("k", features.byte_window(F.col("b"))).collect())
    assert {len(w) for w in got.values()} == {4096} and got[0][:3] == [1, 256, 0] and not any(got[1]) and not any(got[2])
    assert got[3][3070:3074] == [255, 256, 1, 2] and got[3][-1] == 256
    assert spark.range(3000).select(F.size(features.byte_window(F.lit(b"x"))).alias("n")).groupBy("n").count().collect() == [(4096, 3000)]


def test_hashed_vectors_have_the_places_of_spark(spark):
    texts = ["", "a", "ab", " \t ", "one two  one two three@x.y", "\u00c4rger \u0451\u043b\u043a\u0430 \U0001f600\U0001f600 x \u4e2d\u6587\u5b57 \u0130stanbul"]
    rows = spark.createDataFrame([(k, t, float(k)) for k, t in enumerate(texts)], "k int, t string, v double")
    made = features.hashed_vectors(rows, "t", numeric=["v"])
    assert len(made.schema["features"].json()) < 1000  # a list of all attributes would travel with each task
    old = rows.withColumns({"w": X.tokens(F.col("t"), X.TOKEN_PATTERNS["words2"]), "c": features.char_wb_ngrams(F.col("t"))})
    old = NGram(n=2, inputCol="w", outputCol="b").transform(old).withColumn("wb", F.concat("w", "b"))
    for c, size in (("wb", 1 << 18), ("c", 1 << 17)):
        old = Normalizer(inputCol=c + "r", outputCol=c + "f").transform(HashingTF(numFeatures=size, inputCol=c, outputCol=c + "r").transform(old))
    want = {r["k"]: np.concatenate([r["wbf"].toArray(), r["cf"].toArray(), [r["v"]]]) for r in old.collect()}
    got = {r["k"]: r["features"].toArray() for r in made.collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], rtol=1e-14, atol=0) for k in want)


def test_folds_are_fitted_side_by_side(spark):
    from threading import Barrier

    both, fit = Barrier(2, timeout=60), experts.logistic()
    rows = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4 > 1).cast("int").alias("fold"))
    rows = VectorAssembler(inputCols=["y"], outputCol="features").transform(rows)
    out = experts.cross_fit(rows, lambda train: both.wait() is not None and fit(train), 2)
    assert out.filter("(p >= 0.5) = (y = 1)").count() == 40


def test_folds_are_dealt_without_texts(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 2, f"some words {k}", "s") for k in range(20)], "doc_id long, y int, text string, source string")
    monkeypatch.setattr(models, "messages", lambda *_: rows)
    seen, deal = [], split.stratified_folds
    monkeypatch.setattr(split, "stratified_folds", lambda rows, *given: seen.append(rows.columns) or deal(rows, *given))
    got = {r["msg_id"]: r["fold"] for r in models._rows(spark, "").select("msg_id", "fold").collect()}
    assert seen == [["msg_id", "y"]]
    assert got == dict(deal(rows.withColumnRenamed("doc_id", "msg_id"), "msg_id", 5, 7).select("msg_id", "fold").collect())
