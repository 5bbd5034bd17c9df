"""Embedding near-dedup: all links of at least a given cosine between vectors with equal labels, through a pruned flat graph.

1. Equal vectors (label and components) are one node with a count.
2. Nodes are dealt to home shards by the nearest of some sampled nodes, round by round, until shards are small. In each
   shard, balls form around leaders: a node joins the first leader that it links to.
3. Leaders are dealt to overlapping shards: the nearest sampled leader and the next ones that are nearly as near, at most
   ``OVERLAP`` in a round, whatever the width of the vectors. In each shard robust pruning makes a graph; a leader's adjacency lists from its
   shards are united.
4. Each leader is searched for in its home shard: greedily from the shard's medoid (and the leader itself), then
   expanding every node in range, which allows for the radius of both balls.
5. An audit compares up to ``audit`` leaders' results with all leaders; if recall is below ``least_recall`` the
   search is repeated with a wider beam, at last over all shard members.
6. Pairs of balls in range are verified member by member in double precision, in blocks of bounded size, so a huge ball is
   many tasks. Only verified links count.
7. The links themselves are audited: those of some vectors, more of them until enough links are seen, are counted by brute
   force. If recall is below ``least_links``, all pairs of leaders of a label are compared in blocks, which is exact.

The work is linear but for step 6, which looks at pairs of members of balls that are near each other, that is of groups of near
copies; nothing lists those pairs, they are counted inside the tasks.

Defined cases: vectors that are null, all zero, or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of different lengths don't link; repeated rows are vectors of their own and link with each
other; a component's name is the smallest id of its rows; kept is true where that is the row's own id (for repeated ids:
for each of them); an empty table gives an empty result. Other columns of the input are not looked at, whatever
their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import cut, lean, ship
from sieve.llm.components import components

SHARD, FAN, BALL_BLOCK = 2048, 32, 1024
DEGREE, CANDIDATES, ALPHA = 16, 40, 1.2
OVERLAP, SEEN_LINKS, MOST_SAMPLED = 3, 50, 2048


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _column(column, slice_rows: int = 0) -> np.ndarray:
    """A list column of equal lengths as a matrix of unit rows."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Runs of rows that are equal in the first columns, as slices of batches."""

    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
            start = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[start]:
                    yield names[start], batch.slice(start, k - start)
                    start = k

    for key, run in itertools.groupby(slices(), key=lambda x: x[0]):
        yield key, (batch for _, batch in run)


# -- dealing to shards --------------------------------------------------------------------------------------------


def _assign(margin: float | None):
    """Rows (shard, part, kind, node, vector, home), samples (kind 0) before nodes -> (shard, node, vector, home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, _), group in _grouped(batches, 2):
            heads, names = [], []
            ready = None
            for batch in group:
                kind = np.array(batch.column(2).to_pylist())
                n = int((kind == 0).sum())
                if n:
                    heads.append(_column(batch.column(4).slice(0, n)))
                    names += batch.column(3).slice(0, n).to_pylist()
                batch = batch.slice(n)
                if not batch.num_rows:
                    continue
                if ready is None:
                    order = np.argsort(names)
                    ready = np.vstack(heads)[order] if heads else np.zeros((0, 1))
                    names = np.array(names, dtype=np.int64)[order]
                nodes, vectors = batch.column(3), batch.column(4)
                home = np.array(batch.column(5).to_pylist(), dtype=bool)
                if len(ready) < 2:
                    yield _shard_rows(np.full(len(nodes), shard), nodes, vectors, home)
                    continue
                angle = np.arccos(np.clip(_column(vectors) @ ready.T, -1, 1))
                nearest = angle.argmin(axis=1)
                if margin is None:
                    row, col = np.arange(len(nearest)), nearest
                else:
                    top = min(OVERLAP, len(ready))
                    near = np.argsort(angle, axis=1, kind="stable")[:, :top]
                    far = np.take_along_axis(angle, near, axis=1)
                    close = far <= np.maximum(far[:, :1] + margin, far[:, 1:2])
                    row, rank = np.nonzero(close)
                    col = near[row, rank]
                new = _mixed(shard, names[col])
                at = pa.array(row)
                yield _shard_rows(new, nodes.take(at), vectors.take(at), home[row] & (nearest[row] == col))

    return lean(run)


def _mixed(shard: int, names: np.ndarray) -> np.ndarray:
    from sieve.llm.shingles import U, mix

    return (mix(names.view(np.uint64) if names.dtype == np.int64 else names.astype(np.uint64), 41) ^ mix(np.array([shard], dtype=np.int64).view(np.uint64), 42)).view(np.int64)


def _shard_rows(shards: np.ndarray, nodes, vectors, home: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), nodes, vectors, pa.array(home, pa.bool_())], ["shard", "node", "vector", "home"])


def _shards(nodes: DataFrame, margin: float | None, size: int, name: str, most_rounds: int = 6) -> DataFrame:
    """(shard, node, vector, home) from (label_key, node, vector): shards of about ``size`` nodes where that is possible."""
    kind = nodes.schema["vector"].dataType.simpleString()
    now = nodes.select(F.col("group").alias("shard"), "node", "vector", F.lit(True).alias("home"))
    before = None
    for k in range(most_rounds):
        now = cut(now, f"{name}-shards")
        counts = now.groupBy("shard").agg(F.count("*").alias("n"))
        over = counts.filter(F.col("n") > 2 * size)
        state = tuple(over.agg(F.count("*"), F.max("n")).first())
        if not state[0] or (before and state[1] > 0.8 * before):
            return now
        before = state[1]
        # About FAN samples of each large shard (fewer where fewer shards will do), by hash: no order, no list.
        wanted = F.least(F.lit(FAN), F.ceil(F.col("n") / size))
        large = now.join(over.withColumn("every", F.ceil(F.col("n") / wanted)).withColumn("parts", F.ceil(F.col("n") / 65536).cast("int")), "shard")
        sample = large.filter(F.pmod(F.xxhash64(F.lit(k), "node"), F.col("every")) == 0).dropDuplicates(["shard", "node"])
        sample = sample.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "vector", "home")
        rows = large.select("shard", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "node", "vector", "home")
        dealt = (
            sample.unionByName(rows)
            .repartition("shard", "part")
            .sortWithinPartitions("shard", "part", "kind")
            .mapInArrow(_assign(margin), f"shard long, node long, vector {kind}, home boolean")
        )
        now = now.join(over.select("shard"), "shard", "left_anti").unionByName(dealt)
    return cut(now, f"{name}-shards")


# -- balls ------------------------------------------------------------------------------------------------------------


def _balls(least: float, most: int):
    """Nodes of a home shard -> (node, leader). A shard that stayed large is worked through in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 1):
            nodes, parts, n = [], [], 0
            for batch in itertools.chain(group, [None]):
                if batch is not None:
                    nodes += batch.column(1).to_pylist()
                    parts.append(_column(batch.column(2)))
                    n += batch.num_rows
                if n and (batch is None or n >= most):
                    x, ids = np.vstack(parts), np.array(nodes)
                    order = np.argsort(ids)
                    x, ids = x[order], ids[order]
                    leader = np.full(n, -1)
                    for k in range(n):
                        if leader[k] < 0:
                            near = (x[k:] @ x[k] >= least) & (leader[k:] < 0)
                            near[0] = True
                            leader[k:][near] = k
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[leader])], ["node", "leader"])
                    nodes, parts, n = [], [], 0

    return lean(run)


# -- graph -------------------------------------------------------------------------------------------------------------


def robust_prune(x: np.ndarray, q: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of q: nearest first, leaving out candidates that a chosen neighbour is much nearer to than q."""
    far = 1 - x[candidates] @ x[q]
    order = np.argsort(far, kind="stable")
    candidates, far = candidates[order], far[order]
    chosen = []
    while len(candidates) and len(chosen) < degree:
        p = candidates[0]
        chosen.append(p)
        keep = alpha * (1 - x[candidates] @ x[p]) > far
        keep[0] = False
        candidates, far = candidates[keep], far[keep]
    return np.array(chosen, dtype=np.int64)


def flat_graph(x: np.ndarray) -> list[np.ndarray]:
    """Pruned adjacency lists over the rows of x, with reverse edges."""
    n = len(x)
    out: list[np.ndarray] = []
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    top = min(CANDIDATES, n - 1)
    rng = np.random.default_rng(1)
    for start in range(0, n, 512):
        near = x[start : start + 512] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -2
        nearest = np.argpartition(-near, top - 1, axis=1)[:, :top]
        for k, c in enumerate(nearest):
            q = start + k
            far = rng.integers(0, n, 8)  # a few long edges keep the graph in one piece
            c = np.unique(np.concatenate([c, far[far != q]]))
            out.append(robust_prune(x, q, c))
    back: list[list[int]] = [[] for _ in range(n)]
    for q, own in enumerate(out):
        for p in own.tolist():
            back[p].append(q)
    for q in range(n):
        both = np.unique(np.concatenate([out[q], np.array(back[q], dtype=np.int64)]))
        out[q] = both if len(both) <= 2 * DEGREE else robust_prune(x, q, both, 2 * DEGREE)
    return out


def search(x: np.ndarray, graph: list[np.ndarray], start: list[int], q: np.ndarray, reach: float, beam: int) -> np.ndarray:
    """Rows of x with a cosine of at least reach to q: greedy search, then everything in range is expanded."""
    near = np.full(len(x), -2.0)
    open_ = np.zeros(len(x), dtype=bool)
    seen = list(dict.fromkeys(start))
    near[seen] = x[seen] @ q
    open_[seen] = True
    while True:
        live = np.array(seen)
        value = near[live]
        bar = np.partition(value, -beam)[-beam] if len(live) > beam else -2.0
        ready = live[open_[live] & (value >= min(bar, reach))]
        if not len(ready):
            return live[value >= reach]
        ready = ready[np.argsort(-near[ready])][:8] if near[ready].max() < reach else ready
        open_[ready] = False
        new = np.unique(np.concatenate([graph[k] for k in ready.tolist()]))
        new = new[near[new] == -2.0]
        near[new] = x[new] @ q
        open_[new] = True
        seen += new.tolist()


def _build():
    """Leaders of a shard -> (leader, near): adjacency lists by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 1):
            parts = list(group)
            ids = np.array([v for b in parts for v in b.column(1).to_pylist()])
            x = np.vstack([_column(b.column(2)) for b in parts])
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            near = [ids[g].tolist() for g in flat_graph(x)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near, pa.list_(pa.int64()))], ["leader", "near"])

    return lean(run)


def _searched(reach: float, beam: int):
    """Rows (shard, leader, vector, home, near) of a shard -> pairs (a, b), a < b, in range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 1):
            parts = list(group)
            ids = np.array([v for b in parts for v in b.column(1).to_pylist()])
            x = np.vstack([_column(b.column(2)) for b in parts])
            home = np.array([v for b in parts for v in b.column(3).to_pylist()], dtype=bool)
            near = [v for b in parts for v in b.column(4).to_pylist()]
            order = np.argsort(ids)
            ids, x, home, near = ids[order], x[order], home[order], [near[k] for k in order]
            graph = []
            for own in near:
                own = np.array(own or [], dtype=np.int64)
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                graph.append(at[ids[at] == own])
            medoid = int((x @ x.mean(axis=0)).argmax())
            a, b = [], []
            for q in np.flatnonzero(home):
                found = search(x, graph, [medoid, int(q)], x[q], reach, min(beam, len(x)))
                found = found[found != q]
                a.append(np.minimum(ids[found], ids[q]))
                b.append(np.maximum(ids[found], ids[q]))
            if a:
                pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return lean(run)


# -- verification -------------------------------------------------------------------------------------------------------


def _verified(least: float):
    """Rows (pair_a, pair_b, block_a, block_b, side, node, vector, m) of two blocks -> (a, b, links).

    Links of node a: the copies of nodes linked with it; b is null there. With links null: a and b are connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pa_, pb, ba, bb), group in _grouped(batches, 4):
            parts = list(group)
            side = np.array([v for b in parts for v in b.column(4).to_pylist()])
            ids = np.array([v for b in parts for v in b.column(5).to_pylist()])
            x = np.vstack([_column(b.column(6)) for b in parts])
            m = np.array([v for b in parts for v in b.column(7).to_pylist()], dtype=np.int64)
            same = pa_ == pb and ba == bb
            left = np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            links = np.zeros(len(ids), dtype=np.int64)
            parent = list(range(len(ids)))

            def find(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for start in range(0, len(left), 256):
                rows = left[start : start + 256]
                near = x[rows] @ x[right].T >= least
                if same:
                    near[rows[:, None] == right[None, :]] = False
                links[rows] += near @ m[right]
                if not same:
                    links[right] += near.T @ m[rows]
                for k, hits in zip(rows, near):
                    # Roots first: in a group of copies nearly all have one.
                    for h in np.unique([find(int(v)) for v in right[hits]]).tolist() if hits.any() else ():
                        p, q = find(int(k)), find(h)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
            counted = np.flatnonzero(links)
            roots = np.array([find(k) for k in range(len(ids))])
            joined = np.flatnonzero(roots != np.arange(len(ids)))
            if len(counted) or len(joined):
                n = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[counted], ids[joined]]), n),
                        pa.array([None] * len(counted) + ids[roots[joined]].tolist(), n),
                        pa.array(links[counted].tolist() + [None] * len(joined), n),
                    ],
                    ["a", "b", "links"],
                )

    return lean(run)


def _verify(pairs: DataFrame, members: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, links) from pairs (a, b) of leaders and members (leader, node, vector, m)."""
    kind = members.schema["vector"].dataType.simpleString()
    sizes = members.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "leader").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    sized = pairs.join(sizes.select(F.col("leader").alias("a"), F.col("blocks").alias("blocks_a")), "a")
    sized = sized.join(sizes.select(F.col("leader").alias("b"), F.col("blocks").alias("blocks_b")), "b")
    tasks = (
        sized.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
        .withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
        .filter("a <> b or block_a <= block_b")
        .select("a", "b", "block_a", "block_b")
    )
    sides = tasks.withColumn("side", F.lit(0)).withColumn("leader", F.col("a")).withColumn("block", F.col("block_a"))
    other = tasks.filter("a <> b or block_a <> block_b").withColumn("side", F.lit(1)).withColumn("leader", F.col("b")).withColumn("block", F.col("block_b"))
    laid = sides.unionByName(other).join(placed, ["leader", "block"])
    return (
        laid.select("a", "b", "block_a", "block_b", "side", "node", "vector", "m")
        .repartition("a", "b", "block_a", "block_b")
        .sortWithinPartitions("a", "b", "block_a", "block_b", "side")
        .mapInArrow(_verified(least), "a long, b long, links long")
    )


# -- audit ---------------------------------------------------------------------------------------------------------------


def _audit(leaders: DataFrame, pairs: DataFrame, reach: float, most: int) -> float:
    """The share of in-range pairs of some leaders (at most about ``most``, by hash) that were found; all leaders are looked at."""
    n = leaders.count()
    if n < 2:
        return 1.0
    chosen = leaders.filter(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(max(1, n // most))) == 0).limit(2 * most).collect()
    if not chosen:
        return 1.0
    groups = np.array([r["group"] for r in chosen])
    ids, x = np.array([r["node"] for r in chosen]), [np.array(r["vector"], dtype=np.float64) for r in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), rows in _grouped(batches, 1):
            own = np.flatnonzero(groups == group)
            if not len(own):
                continue
            q = _unit([x[k] for k in own])
            for batch in rows:
                i, j = np.nonzero(q @ _column(batch.column(2)).T >= reach)
                a, b = ids[own][i], np.array(batch.column(1).to_pylist())[j]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    true = leaders.select("group", "node", "vector").mapInArrow(lean(run), "a long, b long").distinct()
    true = cut(true, "audit")
    total = true.count()
    return true.join(pairs, ["a", "b"], "left_semi").count() / total if total else 1.0


def link_recall(nodes: DataFrame, links: DataFrame, least: float, most: int) -> float:
    """The share of the links of some nodes that were found, copies of other nodes counted; 1 if there are none.

    About ``most`` nodes are taken by hash and compared with all nodes; if they have few links, eight times as many, up to
    a fixed number.
    """
    n = nodes.count()
    while True:
        chosen = nodes.filter(F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(max(1, n // most))) == 0).select("node", "group", "vector").limit(2 * most).collect()
        groups, ids = np.array([r["group"] for r in chosen]), np.array([r["node"] for r in chosen])
        x = [np.array(r["vector"], dtype=np.float64) for r in chosen]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (group,), rows in _grouped(batches, 1):
                own = np.flatnonzero(groups == group)
                if not len(own):
                    continue
                q = _unit([x[k] for k in own])
                for batch in rows:
                    other, m = np.array(batch.column(1).to_pylist()), np.array(batch.column(3).to_pylist(), dtype=np.int64)
                    near = (q @ _column(batch.column(2)).T >= least) & (ids[own][:, None] != other[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(near @ m)], ["node", "true"])

        true = nodes.select("group", "node", "vector", "m").mapInArrow(lean(run), "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        seen = true.join(links, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first() if chosen else (0, 0)
        if (seen[0] or 0) >= SEEN_LINKS or most >= min(n, MOST_SAMPLED):
            return seen[1] / seen[0] if seen[0] else 1.0
        most = min(8 * most, MOST_SAMPLED)


def _all_pairs(leaders: DataFrame, reach: float, block: int) -> DataFrame:
    """Pairs (a, b), a < b, of leaders of a label in range, by comparing each two blocks of them: exact, and quadratic."""
    sizes = leaders.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = leaders.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "vector", (F.col("own") > F.col("other")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), group in _grouped(batches, 3):
            parts = list(group)
            ids = np.array([v for b in parts for v in b.column(3).to_pylist()])
            x = np.vstack([_column(b.column(4)) for b in parts])
            side = np.array([v for b in parts for v in b.column(5).to_pylist()], dtype=bool)
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            if low == high:
                right = left
            for start in range(0, len(left), 256):
                some = left[start : start + 256]
                i, j = np.nonzero(x[some] @ x[right].T >= reach)
                a, b = ids[some][i], ids[right][j]
                keep = a < b if low == high else a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    return rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high").mapInArrow(lean(run), "a long, b long")


def vector_dedup(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    shard: int = SHARD,
    beam: int = 24,
    audit: int = 64,
    least_recall: float = 0.97,
    least_links: float = 0.95,
    block: int = BALL_BLOCK,
) -> DataFrame:
    """One row per row of ``embeddings``: id, n_links, component_id, kept."""
    ship(embeddings.sparkSession)
    v = F.col("vector")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = embeddings.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).withColumn("row", F.monotonically_increasing_id())
    valid = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = cut(rows.withColumn("valid", F.coalesce(valid, F.lit(False))), "vectors")  # the row numbers are fixed from here
    good = rows.filter("valid")
    nodes = good.groupBy("label", "vector").agg(F.min("row").alias("node"), F.count("*").alias("m"))
    nodes = cut(nodes.select(F.xxhash64("label", F.size("vector")).alias("group"), "label", "vector", "node", "m"), "vector-nodes")
    homes = _shards(nodes.select("group", "node", "vector"), None, shard, "home")
    balls = homes.select("shard", "node", "vector").repartition("shard").sortWithinPartitions("shard")
    balls = cut(balls.mapInArrow(_balls(least, 4 * shard), "node long, leader long"), "balls")
    leaders = nodes.join(balls.filter("node = leader").select("node"), "node", "left_semi").select("group", "node", "vector")
    leaders = cut(leaders, "leaders")
    radius = float(np.arccos(least))
    reach = float(np.cos(min(np.pi, 3 * radius + 1e-6)))
    shards = _shards(leaders, 0.12, shard, "leader")
    graph = shards.select("shard", "node", "vector").repartition("shard").sortWithinPartitions("shard").mapInArrow(_build(), "leader long, near array<long>")
    graph = cut(graph.groupBy("leader").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    laid = shards.join(graph.withColumnRenamed("leader", "node"), "node").select("shard", "node", "vector", "home", "near")
    laid = laid.repartition("shard").sortWithinPartitions("shard")
    for width in (beam, 8 * beam, 1 << 30):
        pairs = cut(laid.mapInArrow(_searched(reach, width), "a long, b long").distinct(), "near-balls")
        recall = _audit(leaders, pairs, reach, audit)
        if recall >= least_recall:
            break
    members = nodes.select("node", "vector", "m").join(balls, "node")
    many = balls.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("leader").alias("a"), F.col("leader").alias("b"))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = cut(_verify(pairs.unionByName(many), members, least, block), "vector-links")
        return found, found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    found, links = verified(pairs)
    if link_recall(nodes, links, least, audit) < least_links:
        found, links = verified(cut(_all_pairs(leaders, reach, block), "all-balls"))
    classes = components(found.filter("links is null"), "a", "b")
    named = nodes.join(links, "node", "left").join(classes, "node", "left")
    named = named.select("label", "vector", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    same = (F.col("l.label") == F.col("r.label")) & (F.col("l.vector") == F.col("r.vector"))
    linked = cut(
        good.select("id", "label", "vector").alias("l").join(named.alias("r"), same).select("id", (F.col("links") + F.col("m") - 1).alias("n_links"), "component"),
        "vector-rows",
    )
    least_id = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = linked.join(least_id, "component").select("id", "n_links", "component_id")
    alone = rows.filter("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
