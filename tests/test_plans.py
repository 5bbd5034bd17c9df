"""Readers, writers, training and scoring, experts, streams and registration, end to end on small data."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from sieve.functions.register import register
from sieve.operators import experts, split, weights
from sieve.plans import evaluation, scoring
from sieve.sources import readers, sinks
from sieve.streaming import scoring as streaming

SF = "/root/testdata/sf0.001"


def parsed(spark, n: int):
    row = F.when(F.col("id") % 2 == 1, F.concat(F.lit("win free prize money "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("meeting notes agenda "), F.col("id").cast("string")))
    return spark.range(n).select(
        F.col("id").alias("msg_id"), F.lit("hello").alias("subject"), F.lit("a@b.cc").alias("from"), F.lit("d@e.ff").alias("to"), row.alias("text"),
        F.create_map().cast("map<string,string>").alias("headers"), F.lit(0).alias("url_count"), F.lit(0).alias("attachment_count"), F.lit(False).alias("has_html"),
        F.lit(100).alias("raw_length"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") == 4).alias("base_flag"),
    )


def test_train_save_load_score(spark, tmp_path):
    config = scoring.ScoringConfig(dimension=2048, most_fpr=0.05)
    model = scoring.train(parsed(spark, 60), parsed(spark, 40), config)
    assert model.recall == 1.0 and model.fpr <= 0.05 + 1e-9
    path = str(tmp_path / "model")
    fingerprints = spark.createDataFrame([("ab", 1)], "exact string, simhash long")
    sinks.save_weights(path, {"bias": model.bias, "spam_threshold": 0.8, "ham_threshold": 0.2}, model.weights, fingerprints)
    settings, w, prints = readers.load_weights(spark, path)
    assert settings["bias"] == pytest.approx(model.bias) and prints.first()["exact"] == "ab"
    before = {r["idx"]: r["w"] for r in model.weights.filter("w <> 0").collect()}
    assert {r["idx"]: pytest.approx(r["w"], abs=1e-5) for r in w.collect()} == before
    out = {r["msg_id"]: r for r in scoring.score(parsed(spark, 10), w, settings["bias"], config).collect()}
    assert out[1]["p"] > 0.5 > out[0]["p"] and out[4]["decision"] == "Spam" and out[4]["risk"] == 1.0
    assert 0 < len(out[1]["explanations"]) <= 8
    rows = scoring.score(parsed(spark, 4), w, settings["bias"], config).withColumns({"path": F.lit('a"b'), "y": F.lit(1), "fingerprint": F.lit("f"), "action": F.lit(None).cast("string"), "rscore": F.lit(1.5)})
    text = sinks.prediction_csv(rows).decode("utf-8-sig").splitlines()
    assert text[0].startswith("path,label") and text[1].startswith('"a""b",spam,f,') and len(text) == 5


def test_protection_can_be_turned_off(spark):
    w = spark.createDataFrame([(0, 0.0)], "idx int, w double")
    one = parsed(spark, 5).filter("msg_id = 4")
    assert scoring.score(one, w, -20.0).first()["decision"] == "Spam"
    assert scoring.score(one, w, -20.0, scoring.ScoringConfig(protect=False)).first()["decision"] == "Normal"


def test_leakage_guard(spark):
    rows = spark.createDataFrame([(1, "The same words 123"), (2, "something else entirely different here")], "k long, t string")
    test = spark.createDataFrame([(9, "the SAME words 456")], "k long, t string")
    assert [r["k"] for r in scoring.guard_leakage(rows, test, "k", "t").collect()] == [2]


def test_readers(spark, tmp_path):
    for name in ("spam/a.eml", "spam/.hidden", "ham/sub/b.eml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = sorted((r["path"].rsplit("/", 1)[1], r["y"], r["source"]) for r in readers.labelled_folders(spark, str(tmp_path / "spam"), str(tmp_path / "ham"), "s").collect())
    assert got == [("a.eml", 1, "s"), ("b.eml", 0, "s")]
    with pytest.raises(Exception):
        readers.files_under(spark, str(tmp_path / "missing")).count()
    with pytest.raises(ValueError):
        readers.single_message(spark, b"")
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:bz2") as tar:
        for name in ("d/1", "d/cmds", "d/.x"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "c.tar.bz2").write_bytes(buffer.getvalue())
    assert [(r["path"], bytes(r["raw"])) for r in readers.archive(spark, str(tmp_path / "c.tar.bz2")).collect()] == [("d/1", b"hi")]
    (tmp_path / "c.csv").write_text('Spam/Ham,Subject,Message,Date\nspam,S,"two\nlines ""q""",d\nSpam,S,"two\nlines ""q""",d\nother,x,y,z\nham,,,\n')
    assert sorted((r["y"], r["text"]) for r in readers.csv_corpus(spark, str(tmp_path / "c.csv")).collect()) == [(0, ""), (1, 'two\nlines "q"')]
    (tmp_path / "m.json").write_text(json.dumps({"version": 40, "train": [{"file": "a", "y": 1, "source": "s"}], "val": [], "test": [{"file": "b", "y": 0, "source": "s"}]}))
    assert {(r["split"], r["ord"], r["file"]) for r in readers.manifest(spark, str(tmp_path / "m.json"), 40).collect()} == {("train", 0, "a"), ("test", 0, "b")}
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.json"), 41)
    mixed = spark.createDataFrame([("Subject: Hi\nbody", 1), ("x", 7)], "text string, labels int")
    assert [tuple(r) for r in readers.adapt(mixed, "mixed", "m").collect()] == [("Hi", "Subject: Hi\nbody", 1, "m")]
    with pytest.raises(ValueError):
        readers.adapt(mixed, "mixed", "m", least=100)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"a"), 1)], "raw binary, y int")
    sinks.write_jsonl(rows, str(tmp_path / "p"))
    got = readers.predictions(spark, str(tmp_path / "p"), "id string, y int, raw string").first()
    assert len(got["id"]) == 64 and got["raw"] is None
    fresh = spark.createDataFrame([("abcd", "{}")], "key string, reply string")
    sinks.append_cache(fresh, str(tmp_path / "cache"))
    sinks.append_cache(fresh, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    assert json.loads(sinks.report_json({"spam_total": 1}))["spamTotal"] == 1
    assert "| 50.000% | — |" in sinks.report_markdown("T", [{"a": 0.5, "b": None}])


def test_single_file_model(spark):
    w = spark.createDataFrame([(3, 0.5), (2047, -1.25)], "idx int, w double")
    prints = spark.createDataFrame([("ab" * 32, 7), ("cd" * 32, -9)], "exact string, simhash long")
    raw = sinks.model_bytes(w, 2048, 0.1, 0.8, 0.2, prints, prints)
    settings, weights_, exact, near = readers.parse_model(raw, 2048)
    assert settings == {"dimension": 2048, "bias": 0.1, "spam_threshold": 0.8, "ham_threshold": 0.2}
    assert (weights_[3], weights_[2047], weights_.sum()) == (0.5, -1.25, -0.75) and exact == ["ab" * 32, "cd" * 32] and near.tolist() == [-9, 7]
    for bad in (b"", b"XX" + raw[2:], raw[:8] + b"\2" + raw[9:], raw[:-1], raw + b"x", raw[:60]):
        with pytest.raises(ValueError):
            readers.parse_model(bad, 2048)
    with pytest.raises(ValueError):
        readers.parse_model(raw, 4096)
    with pytest.raises(ValueError):
        sinks.model_bytes(w, 100, 0.0, 0.8, 0.2, prints, prints)


def test_message_files_stay_below_their_folder(spark, tmp_path):
    for name in ("../x.eml", "/x.eml", "a/../../x.eml"):
        with pytest.raises(Exception):
            sinks.write_messages(spark.createDataFrame([(name, bytearray(b"x"))], "file string, raw binary"), "file://" + str(tmp_path)).collect()


def test_report(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], int(k > 60), k / 100, False) for k in range(100)], "msg_id long, source string, y int, score double, base_flag boolean")
    text, table = evaluation.report(rows, 0.0)
    summary = json.loads(text)
    assert summary["rocAuc"] == 1.0 and summary["threshold"] == 0.61 and summary["falsePositives"] == 0
    assert table.count("\n") > 4


def test_experts_and_stack(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(120).select(F.col("id").alias("msg_id"), (F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), ((F.col("id") % 2) + (F.col("id") % 7) / 10).alias("a"), ((F.col("id") % 5) / 5).alias("b"))
    rows = split.stratified_folds(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows), "msg_id", 3, 1).cache()
    for fit in (experts.logistic(), experts.linear_svm(), experts.complement_bayes(), experts.boosted(rounds=2), experts.scaled_logistic()):
        assert experts.cross_fit(rows, fit, 3).filter("p between 0 and 1").count() == 120
    stack = experts.Stack({"lr": experts.logistic(), "nb": experts.complement_bayes()}, experts.logistic(), folds=3).fit(rows)
    assert stack.predict(rows).filter("(score >= 0.5) = (y = 1)").count() >= 110
    assert experts.committee(rows, rows, experts.logistic(), least=10).filter("(p >= 0.5) = (y = 1)").count() >= 110
    assert experts.predict(experts.refit_mined(rows, experts.logistic()), rows).count() == 120
    name, _ = experts.select_by_validation(rows.filter("fold < 2"), rows.filter("fold = 2"), {"a": experts.logistic(), "b": experts.logistic(l2=10.0)}, 0.05)
    assert name in ("a", "b")
    total = weights.source_balanced(rows).groupBy("y").agg(F.sum("weight").alias("m")).collect()
    assert total[0]["m"] == pytest.approx(total[1]["m"])


def test_streams(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(SF)
    assert streaming.run_to_files(streaming.dedupe_stream(stream, "event_type", "ts").select("event_type"), str(tmp_path / "once")).count() == 5
    query = streaming.score_stream(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 1000


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT sieve_fnv32('a') AS a, sieve_fnv64('') AS b, sieve_parse_message(cast('Subject: x\n\nhi' AS binary)).subject AS s").first()
    assert row["a"] == 0xE40C292C and row["b"] % (1 << 64) == 14695981039346656037 and row["s"] == "x"
    assert [r["token"] for r in spark.sql("SELECT * FROM sieve_tokens('Ab cd')").collect()] == ["ab", "cd"]


def test_entry_points(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
