"""Hashes, fingerprints, dedupe, scans and features on golden rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sieve.functions import hashing as H
from sieve.functions import numeric as N
from sieve.functions import text as X
from sieve.operators import audit, dedupe, features, fingerprint, leakage, reputation, scan


def fnv(text: str, bits: int) -> int:
    h, prime = (2166136261, 16777619) if bits == 32 else (14695981039346656037, 1099511628211)
    b = text.encode("utf-16-le")
    for k in range(0, len(b), 2):
        h = ((h ^ (b[k] | b[k + 1] << 8)) * prime) % (1 << bits)
    return h


WORDS = ["", "a", "hello", "Straße", "日本語", "x" * 200, "a_b-c.d@e"]


def test_fnv(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", H.fnv32(F.col("w")).alias("a"), H.fnv64(F.col("w")).alias("b"), H.fnv64_udf("w").alias("c")).collect()
    for r in rows:
        assert r["a"] == fnv(r["w"], 32)
        assert r["b"] % (1 << 64) == fnv(r["w"], 64) == r["c"] % (1 << 64)


def simhash(text: str) -> int:
    import re

    text = re.sub(r"\s+", " ", re.sub(r"\b\d{2,}\b", " <num> ", re.sub(r"https?://\S+", " <url> ", text.lower()))).strip()
    votes = [0] * 64
    tokens = re.findall(r"[^\W_][\w\-.@]{1,48}", text)
    for t in tokens:
        h = fnv(t, 64)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] >= 0) if tokens else 0


def test_simhash_and_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog again and again near the river bank in 1999"
    texts = [base, base + " see https://a.bc/d", base.replace("lazy", "idle"), "", "completely different words stand here"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r["k"]: r["simhash"] for r in fingerprint.near_fingerprint(df, "k", F.col("t")).collect()}
    assert {k: v % (1 << 64) for k, v in got.items()} == {k: simhash(t) for k, t in enumerate(texts)}
    hashes = spark.createDataFrame([(0b1011,), (0b1000,), (1 << 40,), (0b1011,), (-1,)], "simhash long")
    pairs = {(r["a"], r["b"]): r["distance"] for r in fingerprint.near_pairs(hashes, 2).collect()}
    assert pairs == {(0b1000, 0b1011): 2, (0b1000, 1 << 40): 2}
    index = spark.createDataFrame([(0b1011, "AB")], "simhash long, exact string")
    rows = spark.createDataFrame([(1, 0b1010, "x"), (2, 0b100, "ab"), (3, 1 << 50, "y")], "k long, simhash long, exact string")
    assert leakage.leak_counts(rows, index, "k").first().asDict() == {"rows": 3, "exact_leaks": 1, "near_leaks": 1}


def test_near_copies_name_every_document(spark):
    data = [(7, 0b1011), (3, 0b1011), (5, 0b1000), (9, 0b1011), (4, 1 << 40), (6, -1)]
    pairs = sorted(tuple(r) for r in fingerprint.near_copies(spark.createDataFrame(data, "k long, simhash long"), "k", 2).collect())
    assert pairs == [(3, 5, 2), (3, 7, 0), (3, 9, 0), (4, 5, 2)]


def test_dedupe_policies(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 0), (4, "c", 0), (5, "c", 1)], "k long, key string, y int")
    ids = lambda df: sorted(r["k"] for r in df.collect())
    assert ids(dedupe.keep_first(rows, "key", "k")) == [1, 3, 4]
    assert ids(dedupe.drop_all(rows, "key")) == [3]
    assert ids(dedupe.drop_conflicts(rows, "key", "k")) == [1, 3]
    assert dedupe.removal_report(rows, "key").first().asDict() == {"rows": 5, "keys": 3, "conflict_rows": 2, "repeated_rows": 1}


GOOD = {"score": 6.2, "required_score": 15, "action": "add header", "symbols": {"BAYES_SPAM": {"score": 5.1}}}
BAD = [
    *({k: v for k, v in GOOD.items() if k != gone} for gone in GOOD),
    GOOD | {"score": True}, GOOD | {"error": "x"}, GOOD | {"is_skipped": True}, GOOD | {"action": "soft reject"},
    GOOD | {"symbols": {"A": {}}}, GOOD | {"symbols": []}, GOOD | {"score": "6"},
]


def test_scan_validation(spark):
    replies = [json.dumps(x) for x in [GOOD, *BAD]] + ["not json"]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, reply string")
    got = {r["k"]: r["r"] for r in rows.select("k", scan.validate(F.col("reply")).alias("r")).collect()}
    assert got[0] == []
    assert all(got[k] for k in range(1, len(replies)))
    s = rows.filter("k = 0").select(scan.parse_lenient(F.col("reply")).alias("scan"))
    health = scan.require_healthy(s)
    assert health["bayes_hits"] == 1 and health["spam_actions"] == 1
    for bad in (s.filter("false"), s.withColumn("scan", F.struct(F.lit("x").alias("action"), F.lit(0.0).alias("score"), F.lit(1.0).alias("required"), F.col("scan.symbols").alias("symbols")))):
        with pytest.raises(ValueError):
            scan.require_healthy(bad)
    learn = spark.createDataFrame([('{"success": true}',), ('{"success": true, "error": "x"}',), ('{"success": false}',), ("{}",)], "r string")
    assert [r[0] for r in learn.select(scan.learned(F.col("r"))).collect()] == [True, False, False, False]


def test_scan_cache_asks_once(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"a")), (3, bytearray(b"b"))], "k int, raw binary")
    cache = rows.filter("k = 3").select(H.scan_key("n", F.col("raw")).alias("key"), F.lit("old").alias("reply"))
    out, fresh = scan.cached(rows, cache, scan.constant_scanner({"score": 1}), "n")
    assert {r["k"]: r["reply"] for r in out.collect()} == {1: '{"score": 1}', 2: '{"score": 1}', 3: "old"}
    assert fresh.count() == 1


def test_manifest_audit(spark):
    fields = "split string, ord long, file string, y int, source string, sha256 string"
    good = spark.createDataFrame([("train", 0, "a.eml", 1, "s", "h1"), ("val", 0, "b.eml", 0, "s", "h2"), ("test", 0, "c.eml", 1, "s", "h3")], fields)
    assert audit.manifest_problems(good, {"train": 1, "val": 1, "test": 1}).count() == 0
    assert audit.split_digest(good).collect() == audit.split_digest(good.repartition(3)).collect() or len(audit.split_digest(good).collect()) == 3
    bad = good.union(spark.createDataFrame([("test", 1, "../d.eml", 7, "s", "h1")], fields))
    assert {r["problem"] for r in audit.manifest_problems(bad, {"test": 1}).collect()} >= {"label", "path", "shared by splits", "count"}
    with pytest.raises(ValueError):
        audit.require(audit.manifest_problems(bad))
    listing = spark.createDataFrame([("a.eml",), ("b.eml",)], "path string")
    assert [r["file"] for r in audit.missing_files(good, listing).collect()] == ["c.eml"]


def test_out_of_fold_rates_exclude_the_own_fold(spark):
    data = [(k, k % 2, k % 3, "x") for k in range(12)]
    rows = spark.createDataFrame(data, "k long, y int, fold int, sender string")
    long = reputation.entities(rows, "k", {"sender": "sender"}, ("y", "fold"))
    for r in reputation.out_of_fold(rows, long, "k").collect():
        rest = [d for d in data if d[2] != r["fold"]]
        s, n = sum(d[1] for d in rest), len(rest)
        assert r["rate"] == pytest.approx((s + 2 * (s + 1) / (n + 2)) / (n + 2))


def test_message_features(spark):
    row = ("Free prize", "a@b.com", "c@d.org", "win win now https://x.yz/", {}, 1, 0, True, 120, ("no action", 3.2, 15.0, [("TEST_SYMBOL", 1.5, ["1.2.3"])]))
    schema = "subject string, `from` string, `to` string, text string, headers map<string,string>, url_count int, attachment_count int, has_html boolean, raw_length int, scan struct<action:string,score:double,required:double,symbols:array<struct<name:string,score:double,options:array<string>>>>"
    df = spark.createDataFrame([row], schema).withColumn("msg_id", F.lit(1))
    got = {r["label"]: r["value"] for r in features.hashed(df, "msg_id", features.message_features(True)).collect()}
    assert len(got) > 5 and got["body:tok:win"] == 2 and got["subject:bi:free_prize"] == 1 and got["flag:html"] == 1
    assert got["rspamd:symbol:test_symbol"] == 1.5 and got["from_domain:b.com"] == 1 and got["rspamd:option:test_symbol:#.#.#"] == 1
    weights = spark.createDataFrame([(fnv("body:tok:win", 32) & 0x7FFFFFFF & (2**17 - 1), 0.5)], "idx int, w double")
    assert features.dot(features.hashed(df, "msg_id", features.message_features(True)), weights, "msg_id", -1.0).first()["margin"] == 0.0


def test_numbers(spark):
    a = F.array(*map(F.lit, (0.1, 0.4, 0.2, 0.9)))
    r = spark.range(1).select(*N.array_stats(a), N.sigmoid(F.lit(-800.0)).alias("s"), N.ratio(F.lit(1), F.lit(0), 0).alias("z")).first()
    assert r["median"] == pytest.approx(0.3) and r["q75"] == pytest.approx(0.525) and r["second_low"] == 0.2 and r["agree"] == 1
    assert r["s"] == 0.0 and r["z"] == 0.0


def test_bigrams_of_short_texts(spark):
    df = spark.createDataFrame([("",), ("one",), ("one two",)], "t string")
    assert [r[0] for r in df.select(X.bigrams(X.tokens(F.col("t")))).collect()] == [[], [], ["one_two"]]


def test_hashes_read_utf16_units(spark):
    words = ["a𐐀b", "b", "𝒳b", "", "żółw", "日本𠮷語"]

    def slow(word, h, prime, bits):
        for unit in memoryview(word.encode("utf-16-le")).cast("H"):
            h = ((h ^ unit) * prime) & ((1 << bits) - 1)
        return h

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", H.fnv32(F.col("w")).alias("a"), H.fnv64(F.col("w")).alias("b")).collect()
    for r in rows:
        short, long = slow(r["w"], H.FNV32_OFFSET, H.FNV32_PRIME, 32), slow(r["w"], H.FNV64_OFFSET, H.FNV64_PRIME, 64)
        assert (r["a"], r["b"] & (2**64 - 1)) == (short, long)
        assert (int(H.fnv32_all([r["w"]])[0]), int(H.fnv64_all([r["w"]])[0]) & (2**64 - 1)) == (short, long)


def test_simhash_by_hand(spark):
    texts = ["alpha beta alpha 𐐀x𐐀", "", None, "one " * 3000 + "two", "one " * 3000 + "two"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for weighted in (False, True):
        got = {r["k"]: r["simhash"] for r in fingerprint.near_fingerprint(df, "k", F.col("t"), weighted).collect()}
        words = df.select("k", X.tokens(X.fingerprint_text(F.col("t"))).alias("w")).collect()
        for r in words:
            votes = [0] * 64
            for w in set(r["w"] or ()):
                n = min(r["w"].count(w), 4) if weighted else r["w"].count(w)
                h = int(H.fnv64_all([w])[0]) & (2**64 - 1)
                votes = [v + (n if h >> b & 1 else -n) for b, v in enumerate(votes)]
            want = sum(1 << b for b in range(64) if votes[b] >= 0) if r["w"] else 0
            assert got[r["k"]] & (2**64 - 1) == want


def weights(rows: list[tuple], n: int) -> dict:
    """TF-IDF of grams of up to n words by hand; rows of a key count as one text, whose grams don't reach across rows."""
    import math
    import re
    from collections import Counter, defaultdict

    counts = defaultdict(Counter)
    for key, text in rows:
        w = re.findall(r"[\w@.\-]{2,}", (text or "").lower())
        counts[key].update(" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1))
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + d)) + 1 for t, d in df.items() if 2 <= d <= 0.997 * len(rows)}
    out = {}
    for key, c in counts.items():
        own = {t: (1 + math.log(x)) * idf[t] for t, x in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in own.values()))
        out |= {(key, t): x / norm for t, x in own.items() if key is not None}
    return out


ODD = [None, "", "a b c", "ab", "cd ab", "Straße 日本語 ab cd 𝒳𝒴", "ab ab ab ab", "cd.ab x@y.zz cd.ab x@y.zz", "日本語 ab cd", "ab\tcd\n\nab", "z" * 900 + " ab"]


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("more", [[], [(3, "cd ab cd"), (3, "ab cd")], [(None, "ab cd"), (None, "cd x@y.zz")]], ids=["distinct", "repeated", "null"])
def test_tfidf_of_all_terms_by_hand(spark, monkeypatch, n, more):
    from sieve.operators import terms

    monkeypatch.setattr(terms, "CHUNK", 24)  # many chunks and ranges
    monkeypatch.setattr(terms, "RANGE", (16, 64))
    rows = list(enumerate(ODD * 2)) + more
    got = features.tfidf(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t"), n, most_terms=None).collect()
    want = weights(rows, n)
    assert len(got) == len(want)
    assert {(r["k"], r["term"]): r["tfidf"] for r in got} == pytest.approx(want)
    none = spark.createDataFrame([(1, None), (2, " ")], "k long, t string")
    assert features.tfidf(none, "k", F.col("t"), n, most_terms=None).count() == features.tfidf(none.limit(0), "k", F.col("t"), n, most_terms=None).count() == 0


def test_digests_that_share_a_half_stay_apart():
    import numpy as np

    from sieve.operators import terms

    high, low = np.array([7, 5, 7, 5], dtype=np.uint64), np.array([2, 9, 1, 3], dtype=np.uint16)
    assert terms._in_order(high, low).tolist() == [3, 1, 2, 0]


def test_tfidf_of_all_terms_moves_less_than_its_rows(spark):
    import random

    r = random.Random(5)
    rows = [(k, " ".join(f"word{int(r.paretovariate(0.5)) % 2000}" for _ in range(600))) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)

    def written() -> int:
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    n = features.tfidf(df, "k", F.col("t"), 2, most_terms=None).agg(F.count("tfidf")).first()[0]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = written() - before
    assert n > 100_000
    assert moved < sum(len(t) for _, t in rows), moved  # a row for each document and term took several times the texts
