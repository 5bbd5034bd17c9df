"""The pipeline's stages against brute force on a small table, and on an empty one."""

from __future__ import annotations

import pytest

import corpus_pipeline as C
from sieve.llm.common import WORD
from sieve.llm.shingles import shingle_set, word_numbers

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = C.quality(spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert good.columns == docs.columns and kept <= set(text)
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)

    single = C.without_copies(spark, good, SF)
    own = sorted(r["doc_id"] for r in single.collect())
    assert own == sorted({text[d]: d for d in sorted(kept)}.values())

    near = C.without_near_copies(spark, single, SF)
    left = {r["doc_id"] for r in near.collect()}
    sets = dict(zip(own, (set(shingle_set(w, 5).tolist()) for w in word_numbers(text[d].encode() for d in own))))
    parent = {d: d for d in own}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(own):
        for b in own[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert left == {find(d) for d in own}

    mixed = C.mixed(spark, near, SF)
    assert mixed.columns == docs.columns
    import re

    size = lambda d: len(re.findall(WORD, text[d]))
    total = sum(size(r["doc_id"]) for r in mixed.collect())
    assert total == pytest.approx(sum(map(size, left)), rel=0.25)

    out = C.encoded(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.limit(20).union(docs.limit(20))
    assert C.without_copies(spark, twice, SF).count() == docs.limit(20).select("text").distinct().count()
    none = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_null_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "a few words", None, None, None)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in C.STAGES:
        stage(spark, docs, SF).collect()


def test_clashing_columns_and_long_texts(spark):
    """Columns named like helpers, and a text of 2 MB, pass through; results are those without the columns."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = spark.createDataFrame([(10**9, "a long text about rivers and towns. " * 60_000, "en", "src0", 2_160_000)], plain.schema)
    docs = plain.unionByName(long)
    extra = docs.selectExpr("*", "1 AS __id", "'x' AS __sha", "2 AS __source", "3 AS __size", "4 AS __copies", "5 AS __copy", "6 AS ids", "7 AS component_id", "8 AS kept")
    key = lambda rows: sorted((r["doc_id"], r["source"] or "") for r in rows.select("doc_id", "source").collect())
    for name, stage in C.STAGES:
        out = stage(spark, extra, SF)
        assert key(out) == key(stage(spark, docs, SF)), name
        if stage is not C.STAGES[-1][1]:
            assert out.columns == extra.columns
