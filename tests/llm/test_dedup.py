"""Exact dedup, the Jaccard join and vector dedup against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.llm import jaccard_join as J
from sieve.llm.components import components
from sieve.llm.exact_dedup import exact_dedup
from sieve.llm.shingles import PIECE, set_digest, shingle_set, word_numbers
from sieve.llm.vector_dedup import vector_dedup

DOCS = "doc_id long, text string, kept string, __id string"


def words_of(text: str) -> list[str]:
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def shingles(text: str, k: int) -> set:
    w = words_of(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("block,hashed", [(4096, F.xxhash64), (8, lambda c: F.crc32(c) % 5)])
def test_exact_dedup(spark, block, hashed):
    texts = ["", None, "a", "a ", "x" * 100, "x" * 99 + "y", "é" * 50, "x" * 100, "a", "ab" * 3000, "ab" * 3000, "ab" * 2999 + "ba"]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(4, "x" * 100, "c", "d"), (None, "a", "c", "d"), (None, None, "c", "d")]
    got = exact_dedup(spark.createDataFrame(rows, DOCS), block=block, hashed=hashed).collect()
    assert len(got) == len(rows)
    own: dict[str, list] = {}
    for k, t, *_ in rows:
        own.setdefault(t or "", []).append(k)
    for r in got:
        t = next(t for k, t, *_ in rows if k == r["doc_id"] and hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"]) or ""
        ids = [k for k in own[t] if k is not None]
        assert (r["keep_id"], r["group_size"]) == (max(ids), len(own[t]))
    assert sum(r["kept"] for r in got) == len(own)
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def near_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    out = []
    for _ in range(n // 4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 120, 400)))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent,block", [(4, 85, 1024), (5, 80, 2)])
def test_jaccard_components(spark, width, percent, block):
    texts = [*near_texts(width, 160), "", None, "One Two", "one  two", "ONE TWO three", " \t\n", "É é"]
    rows = [(k, t, "c", "d") for k, t in enumerate(texts)] + [(3, texts[3], "c", "d"), (None, "only here and nowhere else at all", "c", "d")]
    sets = [shingles(t or "", width) for t in texts]
    links = [
        (a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = groups(len(sets), links)
    got = J.jaccard_components(spark.createDataFrame(rows, DOCS), width=width, percent=percent, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    if block == 1024:
        assert J.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_keys_find_all_links():
    for width, percent in ((4, 85), (5, 80)):
        texts = near_texts(100 + width, 400)
        sets = [shingle_set(w, width) for w in word_numbers(t.encode() for t in texts)]
        scheme = J.Scheme(percent)
        common = np.random.default_rng(3).random(1 << J.SKETCH_BITS) < 0.3  # any marks keep it exact
        for marks in (None, common):
            keys = [set(scheme.keys(s, marks).tolist()) for s in sets]
            for a in range(len(sets)):
                for b in range(max(0, a - 12), a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if scheme.links(len(sets[a]), len(sets[b]), both) and set_digest(sets[a]) != set_digest(sets[b]):
                        assert keys[a] & keys[b]


def test_trees_prune_no_link():
    texts = near_texts(7, 300)
    sets = [shingle_set(w, 4) for w in word_numbers(t.encode() for t in texts)]
    cell = J.Cell(J.Scheme(85), sets=sets)
    cell.search()
    links = [(a, b) for a in range(len(sets)) for b in range(a) if cell.scheme.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))]
    assert [cell.find(k) for k in range(len(sets))] == groups(len(sets), links)
    assert cell.compared < len(sets) ** 2 / 4
    signed = J.Cell(J.Scheme(85), signatures=[J.signature(x) for x in sets])
    signed.search()
    assert all(signed.find(a) == signed.find(b) for a, b in links)  # signatures rule out no link
    assert len({signed.find(k) for k in range(len(sets))}) > len(sets) / 6
    central = J.Cell(J.Scheme(85), signatures=[J.signature(x) for x in sets])
    central.meet(0)
    assert all(central.find(a) == central.find(b) for a, b in links if 0 in (a, b))


def test_long_texts_give_the_same_words():
    text = ("Alpha beta\tgamma " * 100_000).encode()  # over a piece
    long = next(iter(word_numbers([text])))
    short = next(iter(word_numbers([b"alpha beta gamma "])))
    assert len(text) > PIECE and (long.reshape(-1, 3) == short).all()
    assert len(next(iter(word_numbers([b"x" * (PIECE + 10)])))) == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(200, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = groups(500, links)
    touched = {x for ab in links if ab[0] != ab[1] for x in ab}
    assert got == {k: want[k] for k in touched}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_vector_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.vstack([base, base[:30] + rng.normal(size=(30, 16)) * 0.05, base[:10] + rng.normal(size=(10, 16)) * 0.3, base[:5] * 2, *[base[:1] + rng.normal(size=(40, 16)) * 0.02]])
    label = rng.integers(0, 2, len(x))
    label[60:] = np.concatenate([label[:30], label[:10], label[:5], [label[0]] * 40])
    rows = [(k, [float(v) for v in x[k]], int(label[k])) for k in range(len(x))]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[0][1], None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = vector_dedup(df, shard=16, block=8).collect()
    assert len(got) == len(rows) + len(odd)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, labels, ids = np.vstack([n, n[:1]]), np.append(label, label[0]), [*range(len(x)), 0]
    near = (n @ n.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    roots = groups(len(ids), [(a, b) for a, b in zip(*np.nonzero(near))])
    want = sorted((ids[k], int(near[k].sum()), min(ids[j] for j in range(len(ids)) if roots[j] == roots[k])) for k in range(len(ids)))
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] < 1000)
    assert sum(a != b for a, b in zip(found, want)) <= 0.02 * len(want)  # an approximate index, audited
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got if r["vec_id"] >= 1000)


def test_vector_dedup_of_wide_vectors(spark):
    """768 dimensions, several shards, clashing columns, ties and repeated rows; brute force in double precision."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 768))
    x = np.vstack([base, base[:120] + rng.normal(size=(120, 768)) * 0.06, base[:20], base[:1] + rng.normal(size=(30, 768)) * 0.05])
    rows = [(k, x[k].tolist(), 1, "n", 5) for k in range(len(x))]
    schema = "vec_id long, embedding array<double>, label int, node string, links int"
    got = {r["vec_id"]: r for r in vector_dedup(spark.createDataFrame(rows, schema), shard=32, block=16).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = n @ n.T >= 0.98
    np.fill_diagonal(near, False)
    roots = groups(len(x), [(a, b) for a, b in zip(*np.nonzero(near))])
    found = sum(min(got[k]["n_links"], int(near[k].sum())) for k in range(len(x)))
    assert near.sum() > 300 and found >= 0.95 * near.sum() and all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert sum(got[k]["component_id"] != roots[k] for k in range(len(x))) <= 0.02 * len(x)
    assert vector_dedup(spark.createDataFrame([], schema)).count() == 0


def test_all_pairs_and_link_recall(spark):
    from sieve.llm.vector_dedup import _all_pairs, link_recall

    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(30, 8)), 2, axis=0) + rng.normal(size=(60, 8)) * 0.05
    rows = spark.createDataFrame([(k % 2 // 2, k, x[k].tolist(), 1) for k in range(60)], "group long, node long, vector array<double>, m long")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = n @ n.T >= 0.9
    np.fill_diagonal(near, False)
    want = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    got = [tuple(r) for r in _all_pairs(rows, 0.9, 7).collect()]
    assert len(got) == len(want) and set(got) == want
    links = spark.createDataFrame([(k, int(near[k].sum())) for k in range(60) if near[k].any()], "node long, links long")
    assert link_recall(rows, links, 0.9, 4) == 1.0 and link_recall(rows, links.limit(0), 0.9, 4) == 0.0
