"""Metrics, thresholds and gates against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sieve.operators import gates, metrics, review, split
from sieve.operators.gates import Axis
from sieve.operators.prefix import running_sums


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(k, rng.choice("abc"), y := int(rng.random() < 0.4), min(1.0, round(rng.random() * 0.7 + 0.3 * y, 2)), rng.random() < 0.1, round(rng.random(), 2), k % 3) for k in range(400)]
    df = spark.createDataFrame(data, "msg_id long, source string, y int, score double, base_flag boolean, ham double, fold int").cache()
    return data, df


def test_threshold_of_four_samples(spark):
    df = spark.createDataFrame([(1, 0.95, False), (1, 0.80, False), (0, 0.20, False), (0, 0.10, False)], "y int, score double, base_flag boolean")
    best = gates.threshold_under_fpr(df, 0.0).first()
    assert (best["threshold"], best["tp"], best["fp"]) == (0.80, 2, 0)


def test_nothing_feasible_leaves_the_baseline(spark):
    df = spark.createDataFrame([(0, 0.9, True), (1, 0.5, False)], "y int, score double, base_flag boolean")
    best = gates.threshold_under_fpr(df, 0.0).first()
    assert best["threshold"] > 1 and not best["feasible"] and best["fp"] == 1


def test_threshold_matches_brute_force(rows):
    data, df = rows
    for most in (0.0, 0.05, 0.2, 0.5):
        best, ham, spam = None, sum(1 - r[2] for r in data), sum(r[2] for r in data)
        for t in sorted({r[3] for r in data} | {1.000001}, reverse=True):
            tp = sum(r[2] for r in data if r[4] or r[3] >= t)
            fp = sum(1 - r[2] for r in data if r[4] or r[3] >= t)
            if fp / ham <= most + 1e-12 and (best is None or (tp, -fp, t) > best):
                best = (tp, -fp, t)
        got = gates.threshold_under_fpr(df, most).first()
        if best is None:
            assert not got["feasible"]
        else:
            assert (got["tp"], -got["fp"], got["threshold"]) == best
            assert got["recall"] == pytest.approx(best[0] / spam)


def test_auc_and_ap(rows):
    data, df = rows
    pos, neg = [r[3] for r in data if r[2]], [r[3] for r in data if not r[2]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    assert metrics.roc_auc(df.withColumn("score", F.exp("score"))).first()["roc_auc"] == pytest.approx(auc)
    order = sorted(data, key=lambda r: (-r[3], r[0]))
    tp, total = 0, 0.0
    for k, r in enumerate(order, 1):
        tp += r[2]
        total += r[2] * tp / k
    assert metrics.average_precision(df).first()["average_precision"] == pytest.approx(total / len(pos))
    assert metrics.roc_auc(df.filter("y = 1")).first()["roc_auc"] == 0.0


def test_curve_matches_brute_force(rows):
    data, df = rows
    got = {round(r["threshold"], 4): (r["tp"], r["fp"]) for r in metrics.threshold_curve(df, 20).collect()}
    for i in range(21):
        t = i / 20
        assert got[round(t, 4)] == (sum(r[2] for r in data if r[3] >= t), sum(1 - r[2] for r in data if r[3] >= t))


def test_gates_match_brute_force(rows):
    data, df = rows
    axes = [Axis("score", (0.2, 0.5, 0.8)), Axis("ham", (0.3, 0.6, 0.9), rising=False)]
    hit = lambda r, s, h: r[3] >= s and r[5] <= h
    got = {(r["score"], r["ham"]): (r["tp"], r["fp"]) for r in gates.gate_counts(df, axes).collect()}
    grid = list(itertools.product((0.2, 0.5, 0.8), (0.3, 0.6, 0.9)))
    assert got == {(s, h): (sum(r[2] for r in data if hit(r, s, h)), sum(1 - r[2] for r in data if hit(r, s, h))) for s, h in grid}
    best = gates.two_tier(df, axes, 60, 50).first()
    tiers = [g for g in grid if got[g][1] <= 50]
    pairs = [(sum(r[2] for r in data if hit(r, *p) or hit(r, *o)), sum(1 - r[2] for r in data if hit(r, *p) or hit(r, *o))) for p in tiers for o in tiers]
    top = max((tp, -fp) for tp, fp in pairs if fp <= 60)
    assert (best["tp"], -best["fp"]) == top


def test_running_sums_have_no_seams(rows):
    data, df = rows
    counts = df.groupBy("score").agg(F.count("*").alias("n"))
    got = {r["score"]: r["cum_n"] for r in running_sums(counts, "score", ["n"], pieces=7).collect()}
    assert got == {s: sum(1 for r in data if r[3] >= s) for s in {r[3] for r in data}}


def test_review_lift(spark):
    df = spark.createDataFrame([(k, int(k < 5), 1.0 - k / 100, False) for k in range(100)], "msg_id long, y int, risk double, base_flag boolean")
    r = review.review_lift(df, 5.0).first()
    assert (r["reviewed"], r["top_spam"]) == (5, 5)
    assert r["random_mean"] == pytest.approx(0.25) and r["lift"] == pytest.approx(20)
    empty = review.review_lift(df.filter("msg_id < 0")).first()
    assert empty["candidates"] == 0 and empty["lift"] == 0


def test_folds_are_balanced(rows):
    _, df = rows
    sizes = [r["count"] for r in split.chronological_folds(df, 5, ["msg_id"]).groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) < 400
    assert split.fold_classes(split.stratified_folds(df, "msg_id", 4, 1)).count() == 0
    again = split.hash_split(df.repartition(7), "msg_id", 3, 0.5, 0.2).orderBy("msg_id").select("split").collect()
    assert again == split.hash_split(df, "msg_id", 3, 0.5, 0.2).orderBy("msg_id").select("split").collect()
