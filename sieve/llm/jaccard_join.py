"""N-gram Jaccard join: all links between documents whose shingle sets have at least a given Jaccard similarity.

Equal sets are one node from the start. For the others the join is exact and has two parts.

Cells. Sets that link differ in few shingles: at most d, which follows from the threshold and their sizes. Cut into more
than d segments by hash, they agree on a whole segment. Each set therefore gives one key for each segment, and sets that
share a key are put into a cell under one of them, the hub. Cells that share sets are one cell if that fits a block, so that
most sets move once. In larger groups a set is in as many cells as it has hubs, which is a few, and a large cell is
dealt out to blocks, each with the hub. Keys travel as packed
arrays, and a task that gathers them holds its distinct keys only, however often one occurs.

Segments without a rare shingle (empty ones, or parts of passages that many documents share) would bring unlike sets
together. There are segments to spare for them: a set with no more such segments than that gives no keys for them, and
still has a common key with every set it links to; a set with more gives keys for all. Which shingles are rare is a
fixed function of a count of all shingles in 2^22 buckets: any such function keeps the join exact, and the counts, of fixed
size, only decide how many sets meet in vain.

Signature trees. In each block the sets are leaves of a tree whose nodes hold the OR of their members' token bitmaps and
the range of their sizes. Two nodes are compared top down, and pruned if their sizes can't link, if the bits they share
leave too small an overlap even for the best pair, or if their members are linked already. Leaf pairs that remain are
compared exactly. Members of a large cell that aren't linked to its hub are compared with the cell's other blocks in a
second round. What comes out is a spanning forest of the links, from which components follow by star contraction.

No list of documents, links or components goes to the driver; it sees counts. Every table that is used twice is
written to the shared folder first. Broadcasts are of counted tables, with a shuffle join beyond ``broadcast_rows``.

Defined cases: a null text counts as empty; a text without words has an empty set and links with nothing; a text of fewer
words than ``width`` has one shingle, the whole sequence; repeated rows and equal sets share a component, whose name is
the smallest id of its rows (null ids are left out; a component of null ids only has none); an empty table
gives an empty result. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import cut, lean, ship, text_of
from sieve.llm.components import components
from sieve.llm.shingles import U, mix, set_digest, shingle_set, word_numbers

BLOCK, BLOCK_BYTES = 1024, 24 << 20
KEYS_PER_BUCKET, CHUNK_KEYS, FLUSH_KEYS = 1_500_000, 400_000, 1 << 18
SIGNATURE_BYTES = 0.5  # for a shingle, at most
SKETCH_BITS, SKETCH_PARTS = 22, 64


def sketch_place(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(64 - SKETCH_BITS)).astype(np.int64)


class Scheme:
    """Size classes and segment counts for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]

    def class_of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def segments(self, c: int) -> tuple[int, int]:
        """Of a class: how many segments, and how many of them may be empty without further keys; 0 if none are needed."""
        while len(self.bounds) <= c + 1:
            self.bounds.append(self.bounds[-1] * 100 // self.percent + 1)
        differ = 2 * (self.bounds[c + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        if differ == 0:
            return 0, 0
        spare = 1 + differ // 5
        return differ + 1 + spare, spare

    def keys(self, shingles: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Two sets that link but aren't equal share one of these; ``common`` marks the buckets of frequent shingles."""
        own = self.class_of(len(shingles))
        rare = slice(None) if common is None else ~common[sketch_place(shingles)]
        place, value = mix(shingles, 21) >> U(32), mix(shingles, 22)
        out = []
        for c in (own, own + 1):
            m, spare = self.segments(c)
            if not m:
                continue
            at = ((place * U(m)) >> U(32)).astype(np.int64)
            sums = np.zeros(m, dtype=np.uint64)
            np.add.at(sums, at, value)
            weak = np.bincount(at[rare], minlength=m) == 0
            keys = mix(sums + mix(np.arange(m, dtype=np.uint64), c + 100), 23)
            out.append(keys if weak.sum() > spare else keys[~weak])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def links(self, a: int, b: int, both: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    for batch in batches:
        column = batch.column(1)
        texts = (column[k].as_buffer().to_pybytes() for k in range(batch.num_rows))
        yield batch, (shingle_set(w, width) for w in word_numbers(texts))


def _named(width: int, kind: pa.DataType):
    """A row (id, sid, n) for each text, and at a task's end rows (part, counts): its shingles by bucket, at most 255 each."""

    def rows(ids, names: list, sizes: list, parts: list, counts: list) -> pa.RecordBatch:
        columns = [ids, pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parts, pa.int32()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "sid", "n", "part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch, sets in _sets(batches, width):
            sizes, names = [], []
            for s in sets:
                sizes.append(len(s))
                names.append(set_digest(s) if len(s) else None)
                np.add.at(seen, sketch_place(s), 1)
            yield rows(batch.column(0), names, sizes, [None] * len(sizes), [None] * len(sizes))
        low = np.minimum(seen, 255).astype(np.uint8).reshape(SKETCH_PARTS, -1)
        none = [None] * SKETCH_PARTS
        yield rows(pa.nulls(SKETCH_PARTS, kind), none, none, list(range(SKETCH_PARTS)), [_pack_counts(x) for x in low])

    return lean(run)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A part's counts: all of them, or places (16 bits) and counts of those that aren't 0, whichever is shorter."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 3 * len(at) >= len(counts) else at.astype(np.uint16).tobytes() + counts[at].tobytes()


def _add_counts(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == len(total):
        total += np.frombuffer(packed, dtype=np.uint8)
    else:
        n = len(packed) // 3
        total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint8, n, 2 * n)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts), a part's together -> (part, total) with totals as 64-bit numbers."""
    rows = ((p, c) for batch in batches for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for part, group in itertools.groupby(rows, key=lambda r: r[0]):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, dtype=np.int64)
        for _, counts in group:
            _add_counts(total, counts)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])


def _common(named: DataFrame, total: int) -> np.ndarray:
    """Buckets with many more shingles than chance would give them, as packed bits: 2^22, whatever the size of the corpus."""
    mean = total / (1 << SKETCH_BITS)
    limit = mean + 6 * mean**0.5 + 8

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _summed(batches):
            bits = np.packbits(np.frombuffer(batch.column(1)[0].as_py(), dtype=np.int64) > limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    parts = named.filter("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part")
    found = parts.mapInArrow(lean(marked), "part int, bits binary").collect()  # 64 rows of 8 KB
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS // 8), dtype=np.uint8)
    for r in found:
        out[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _keyed(width: int, percent: int, buckets: int, packed, least: int = FLUSH_KEYS):
    """Rows (bucket, keys, owners, counts): packed low 40 bits of keys, by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        common = np.unpackbits(packed.value).astype(bool)
        keys: list[np.ndarray] = []
        owners: list[int] = []
        seen: set[bytes] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(k) for k in keys])
            flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), counts)
            bucket = ((flat >> U(40)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # stays in order of owners
            flat, owner, bucket = flat[order], owner[order], bucket[order]
            named = np.array(owners, dtype=np.int64)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows: list[list] = [[], [], [], [], []]
            for a, z in zip(edges, [*edges[1:], len(flat)]):
                own, first = np.unique(owner[a:z], return_index=True)
                part = flat[a:z]
                for column, v in zip(
                    rows,
                    (
                        int(bucket[a]),
                        part.astype(np.uint32).tobytes(),
                        ((part >> U(32)) & U(255)).astype(np.uint8).tobytes(),
                        named[own].tobytes(),
                        np.diff(np.append(first, z - a)).astype(np.int32).tobytes(),
                    ),
                ):
                    column.append(v)
            b = pa.binary()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int32(), b, b, b, b))], ["bucket", "low", "high", "owners", "counts"]
            )

        for _, sets in _sets(batches, width):
            for s in sets:
                if len(s) and len(own := scheme.keys(s, common)):
                    name = set_digest(s)
                    if name not in seen:  # copies near each other give the same keys
                        seen.add(name)
                        keys.append(own)
                        owners.append(_short(name))
                        size += len(own)
                if size >= least:
                    yield flush()
                    keys, owners, seen, size = [], [], set(), 0
        if keys:
            yield flush()

    return lean(run)


def _gathered(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a bucket together -> (part, pairs): packed (sid, hub) for sets that share a key with their hub, and for hubs
    themselves, by part of sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[k].as_py() for c in batch.columns) for batch in batches for k in range(batch.num_rows))
        for _, bucket in itertools.groupby(rows, key=lambda r: r[0]):
            known, hubs = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            for chunk in _chunks(bucket):
                key = np.concatenate([np.frombuffer(r[1], np.uint32).astype(np.uint64) | (np.frombuffer(r[2], np.uint8).astype(np.uint64) << U(32)) for r in chunk])
                sid = np.concatenate([np.repeat(np.frombuffer(r[3], np.int64), np.frombuffer(r[4], np.int32)) for r in chunk])
                order = np.lexsort((sid, key))
                key, sid = key[order], sid[order]
                begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                own, hub = key[begins], sid[begins]
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    old = known[at] == own
                    hub = np.where(old, hubs[at], hub)
                else:
                    old = np.zeros(len(own), dtype=bool)
                spread = np.repeat(hub, np.diff(np.append(begins, len(key))))
                linked = sid != spread
                if linked.any():
                    pairs = np.unique(np.column_stack([sid[linked], spread[linked]]), axis=0)
                    heads = np.unique(pairs[:, 1])
                    pairs = np.vstack([pairs, np.column_stack([heads, heads])])
                    part = (mix(pairs[:, 0].copy().view(np.uint64), 51) % U(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    pairs, part = pairs[order], part[order]
                    edges = np.flatnonzero(np.diff(part, prepend=-1))
                    packed = [pairs[a:z].tobytes() for a, z in zip(edges, [*edges[1:], len(part)])]
                    yield pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int32()), pa.array(packed, pa.binary())], ["part", "pairs"])
                known, hubs = np.concatenate([known, own[~old]]), np.concatenate([hubs, hub[~old]])
                order = np.argsort(known)
                known, hubs = known[order], hubs[order]

    return lean(run)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, pairs) of a part together -> its distinct (sid, hub)."""
    rows = ((p, x) for batch in batches for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        known, waiting, size = np.zeros((0, 2), dtype=np.int64), [], 0
        for _, packed in itertools.chain(group, [(None, None)]):
            if packed is not None:
                waiting.append(np.frombuffer(packed, dtype=np.int64).reshape(-1, 2))
                size += len(waiting[-1])
            if waiting and (packed is None or size >= CHUNK_KEYS):
                known, waiting, size = np.unique(np.vstack([known, *waiting]), axis=0), [], 0
        for start in range(0, len(known), 1 << 16):
            own = known[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], ["sid", "hub"])


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    chunk, size = [], 0
    for r in rows:
        chunk.append(r)
        size += len(r[1]) // 4
        if size >= CHUNK_KEYS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def size_class(n: int) -> int:
    """Of a signature: bitmaps of class c have 4 * 2^c bits, between two and four for each shingle."""
    return max(4, int(n).bit_length() - 1)


def signature(shingles: np.ndarray) -> bytes:
    """A set's size, its least mixed shingle and its bitmap: about a twentieth of the set itself."""
    bits = 4 << size_class(len(shingles))
    marks = np.zeros(bits, dtype=bool)
    marks[(mix(shingles, 31) & U(bits - 1)).astype(np.int64)] = True
    head = np.array([len(shingles), mix(shingles, 32).min()], dtype=np.uint64)
    return head.tobytes() + np.packbits(marks, bitorder="little").tobytes()


class Cell:
    """Sets of one block, or only their signatures, and a union-find of the links found.

    With sets, links are exact; with signatures alone a link is a pair that the signatures can't rule out.
    """

    def __init__(self, scheme: Scheme, signatures: list[bytes] | None = None, sets: list[np.ndarray] | None = None):
        self.scheme, self.sets, self.signatures = scheme, sets, signatures
        if sets is not None:
            self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        else:
            self.sizes = np.array([int.from_bytes(x[:8], "little") for x in signatures], dtype=np.int64)
        self.parent = list(range(len(self.sizes)))
        self.compared = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def linked(self, a: int, b: int) -> bool:
        self.compared += 1
        if self.sets is None:
            return True
        small, large = sorted((a, b), key=lambda k: self.sizes[k])
        s, l = self.sets[small], self.sets[large]
        at = np.searchsorted(l, s)
        at[at == len(l)] = 0
        return self.scheme.links(len(s), len(l), int((l[at] == s).sum()))

    def marks(self, members: np.ndarray, c: int) -> np.ndarray:
        """Bitmaps of members, folded to class c."""
        words = (4 << c) // 64
        out = np.zeros((len(members), words), dtype=np.uint64)
        for row, k in enumerate(members):
            own = np.frombuffer(self.signatures[k], np.uint64, offset=16)
            out[row] = np.bitwise_or.reduce(own.reshape(-1, words), axis=0)
        return out

    def _signed(self) -> None:
        if self.signatures is None:
            self.signatures = [signature(s) for s in self.sets]

    def may_link(self, x: tuple, y: tuple) -> np.ndarray:
        """For nodes x against nodes y (bitmaps, least and largest sizes, largest excess of size over bits): whether the
        best pair of members could link by its sizes and the largest overlap that the bitmaps allow."""
        t = self.scheme.percent
        p, low, high, excess = x
        q, low2, high2, excess2 = y
        shared = np.bitwise_count(p[:, None, :] & q[None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(excess[:, None], excess2[None, :])
        most = np.minimum(shared, np.minimum(high[:, None], high2[None, :]))
        fit = (100 * high[:, None] >= t * low2[None, :]) & (100 * high2[None, :] >= t * low[:, None])
        return fit & ((100 + t) * most >= t * (low[:, None] + low2[None, :]))

    def meet(self, hub: int) -> None:
        """Compare all members with one of them."""
        others = np.flatnonzero(np.arange(len(self.sizes)) != hub)
        t, n = self.scheme.percent, self.sizes[hub]
        others = others[(100 * self.sizes[others] >= t * n) & (100 * n >= t * self.sizes[others])]
        if self.sets is None:
            own = size_class(n)
            kinds = np.array([size_class(k) for k in self.sizes[others]], dtype=np.int64)
            close = []
            for c in np.unique(kinds):
                members, width = others[kinds == c], min(own, int(c))
                for start in range(0, len(members), 256):
                    some = members[start : start + 256]
                    close.append(some[self.may_link(_leaves(self.marks(some, width), self.sizes[some]), _leaves(self.marks([hub], width), self.sizes[[hub]]))[:, 0]])
            others = np.concatenate(close) if close else others[:0]
        for k in others.tolist():
            if self.find(k) != self.find(hub) and self.linked(hub, k):
                self.join(hub, k)

    def search(self, apart: np.ndarray | None = None) -> None:
        """Find all links not implied by others; ``apart``: only pairs with different values there.

        Linked sets have sizes of neighbouring classes, so each class makes a tree with the next ones folded to its width.
        """
        if len(self.sizes) < 2:
            return
        self._signed()
        kinds = np.array([size_class(n) for n in self.sizes])
        reach = 0
        while (1 << reach) * self.scheme.percent < 100:
            reach += 1
        for c in np.unique(kinds).tolist():
            members = np.flatnonzero((kinds >= c) & (kinds <= c + reach))
            if len(members) > 1:
                self._tree(members, c)
                self._traverse(apart)

    def _tree(self, members: np.ndarray, c: int, fan: int = 8) -> None:
        """Leaves in order of their least shingles, so that similar sets stand together; levels of nodes above."""
        least = np.array([int.from_bytes(self.signatures[k][8:16], "little") for k in members], dtype=np.uint64)
        self.order = members[np.lexsort((self.sizes[members], least))]
        self.levels = [_leaves(self.marks(self.order, c), self.sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            p, low, high, ex = self.levels[-1]
            at = np.arange(0, len(p), fan)
            self.levels.append(
                (np.bitwise_or.reduceat(p, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(ex, at))
            )
        self.fan = fan

    def one_root(self, level: int, k: int) -> int:
        """The root that all members of a node have, or -1."""
        span = self.fan**level
        members = self.order[k * span : (k + 1) * span]
        root = self.find(int(members[0]))
        return root if all(self.find(int(m)) == root for m in members[1:]) else -1

    def _traverse(self, apart: np.ndarray | None) -> None:
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, x, y = stack.pop()
            if (root := self.one_root(level, x)) >= 0 and root == self.one_root(level, y):
                continue
            below = self.levels[level - 1]
            xs = slice(x * self.fan, min((x + 1) * self.fan, len(below[0])))
            ys = slice(y * self.fan, min((y + 1) * self.fan, len(below[0])))
            may = self.may_link(tuple(v[xs] for v in below), tuple(v[ys] for v in below))
            if x == y:
                may = np.triu(may, 1 if level == 1 else 0)
                if level > 1:
                    np.fill_diagonal(may, True)
            for i, j in np.argwhere(may).tolist():
                i, j = i + xs.start, j + ys.start
                if level > 1:
                    stack.append((level - 1, i, j))
                    continue
                a, b = int(self.order[i]), int(self.order[j])
                if (apart is None or apart[a] != apart[b]) and self.find(a) != self.find(b) and self.linked(a, b):
                    self.join(a, b)


def _leaves(packed: np.ndarray, sizes: np.ndarray) -> tuple:
    return packed, sizes, sizes, sizes - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)


def _cell(scheme: Scheme, exact: bool, values: list[bytes]) -> Cell:
    return Cell(scheme, sets=[np.frombuffer(v, np.uint64) for v in values]) if exact else Cell(scheme, signatures=values)


def _cells(percent: int, exact: bool):
    """Rows of a block together -> links (a, b) of a spanning forest; for blocks of larger cells also the members that aren't
    linked to the hub, as rows with b null. Rows with the same class are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for (hub, block, blocks), rows in itertools.groupby(_set_rows(batches), key=lambda r: r[:3]):
            members = {r[3]: r[4:6] for r in rows}
            names = list(members)
            cell = _cell(scheme, exact, [v[0] for v in members.values()])
            known: dict[int, int] = {}
            for k, (_, linked) in enumerate(members.values()):
                if linked is not None:
                    cell.join(known.setdefault(linked, k), k)
            before = [cell.find(k) for k in range(len(names))]
            heads = [k for k, name in enumerate(names) if _short(name) == hub]
            for h in heads:
                cell.meet(h)
            if len({cell.find(k) for k in range(len(names))}) > 1:
                cell.search()
            roots = [cell.find(k) for k in range(len(names))]
            new = [k for k, r in enumerate(roots) if r != k and before[k] == k]
            a, b = [names[roots[k]] for k in new], [names[k] for k in new]
            rest = []
            if blocks > 1:
                central = {roots[h] for h in heads}
                rest = [names[k] for k, r in enumerate(roots) if r not in central]
            if a or rest:
                yield _link_rows([hub] * (len(a) + len(rest)), [block] * (len(a) + len(rest)), a + rest, b + [None] * len(rest))

    return lean(run)


def _crossing(percent: int, exact: bool):
    """Rows (hub, block, blocks, sid, set, class, home) of a block and some strays of other blocks -> links between the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for (hub, block, _), rows in itertools.groupby(_set_rows(batches), key=lambda r: r[:3]):
            members = {(r[3], r[6]): r[4] for r in rows}
            names = [k[0] for k in members]
            homes = np.array([k[1] for k in members])
            cell = _cell(scheme, exact, list(members.values()))
            cell.search(apart=(homes == block).astype(np.int8))
            roots = [cell.find(k) for k in range(len(names))]
            a = [names[r] for k, r in enumerate(roots) if r != k and names[r] != names[k]]
            b = [names[k] for k, r in enumerate(roots) if r != k and names[r] != names[k]]
            if a:
                yield _link_rows([hub] * len(a), [block] * len(a), a, b)

    return lean(run)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _link_rows(hubs: list, blocks: list, a: list, b: list) -> pa.RecordBatch:
    n = pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(hubs, n), pa.array(blocks, n), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["hub", "block", "a", "b"])


def _packed(width: int, exact: bool):
    """Rows (short, sid, set) of texts with words: whole sets, or their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            out: list[list] = [[], [], []]
            size = 0
            for s in sets:
                if not len(s):
                    continue
                name = set_digest(s)
                value = s.tobytes() if exact else signature(s)
                for column, v in zip(out, (_short(name), name, value)):
                    column.append(v)
                size += len(value)
                if size >= 4 << 20:
                    yield _packed_rows(out)
                    out, size = [[], [], []], 0
            if out[0]:
                yield _packed_rows(out)

    return lean(run)


def _packed_rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary()))], ["short", "sid", "set"])


def _bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    broadcast_rows: int = 400_000,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"id {kind}, sid binary, n long, part int, counts binary"
    counted = cut(base.mapInArrow(_named(width, to_arrow_type(base.schema["id"].dataType)), schema), "shingle-sets")
    named = counted.filter("part is null").select("id", "sid", "n")
    total = named.agg(F.sum("n")).first()[0] or 0
    buckets = int(total * 5.8 * (100 - percent) / (100 + percent) / KEYS_PER_BUCKET) + 1  # keys for a shingle, about
    parts = buckets // 4 + 1
    packed = docs.sparkSession.sparkContext.broadcast(_common(counted, total))
    members = (
        base.mapInArrow(_keyed(width, percent, buckets, packed), "bucket int, low binary, high binary, owners binary, counts binary")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_gathered(parts), "part int, pairs binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(lean(_distinct), "sid long, hub long")
    )
    members = cut(members, "cells")  # hubs depend on the order in which keys arrived
    links = _links(base, named, members, width, percent, broadcast_rows, block)
    classes = components(links, "a", "b")
    node = named.join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    node = node.select("id", "n", F.coalesce("component", "sid").alias("__component"))
    least = node.filter("__component is not null").groupBy("__component").agg(F.min("id").alias("__least"))
    return node.join(least, "__component", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("__component").isNull(), F.col("id")).otherwise(F.col("__least")).alias("component_id"),
    )


def _links(base: DataFrame, named: DataFrame, members: DataFrame, width: int, percent: int, broadcast_rows: int, block: int) -> DataFrame:
    """Links (a, b) between set names that connect all sets that the whole join would."""
    short = _short_column("sid")
    rows = members.count()
    active = members.select("sid").distinct()
    owners = named.filter("sid is not null").select("id", "sid", short.alias("__short"), "n")
    owners = owners.join(_bounded(active.select(F.col("sid").alias("__short")), rows, broadcast_rows), "__short")
    # By whole names: sets whose short names clash go everywhere together.
    owners = cut(owners.groupBy("__short", "sid").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("__row"), F.max("n").alias("n")), "cell-owners")
    sizes = owners.groupBy(F.col("__short").alias("sid")).agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    members = cut(members.join(sizes, "sid"), "sized-members")  # sizes stay with the members from here on

    def named_rows(rows_of: DataFrame, own: DataFrame) -> DataFrame:
        wanted = own.select(F.col("__row.id").alias("__wanted")).distinct()
        return rows_of.alias("l").join(_bounded(wanted, rows, broadcast_rows).alias("r"), F.col("id").eqNullSafe(F.col("__wanted")), "left_semi")

    chosen = cut(named_rows(base, owners), "cell-texts")  # the whole table is read for them once

    def source(names: DataFrame | None, exact: bool) -> DataFrame:
        """(short, sid, set) of active sets, or of those named."""
        texts = chosen
        if names is not None:
            names = names.select(F.col("sid").alias("__short")).distinct()
            texts = named_rows(chosen, owners.join(_bounded(names, rows, broadcast_rows), "__short", "left_semi"))
        return texts.mapInArrow(_packed(width, exact), "short long, sid binary, set binary")

    def dealt(cells: DataFrame, weight: float) -> DataFrame:
        """Cells (hub, sid, n, sets, …) as blocks, each with the hub; ``weight`` is bytes for a shingle."""
        counted = cells.groupBy("hub").agg(
            F.greatest(F.ceil(F.sum("sets") / block), F.ceil(F.sum("n") * weight / BLOCK_BYTES)).cast("long").alias("blocks")
        )
        own = F.when(F.col("sid") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        return cells.drop("n", "sets").join(counted, "hub").withColumn("block", F.explode(own.otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("blocks"))))))

    def grouped(groups: DataFrame, weight: float) -> DataFrame:
        """(sid, group) -> (sid, group, fits): whether the group is one block. Large groups are few rows and found by an aggregate."""
        large = groups.join(sizes, "sid").groupBy("group").agg(F.sum("sets").alias("sets"), F.sum("n").alias("n"))
        large = cut(large.filter((F.col("sets") > block) | (F.col("n") * weight > BLOCK_BYTES)).select("group", F.lit(False).alias("fits")), "large-groups")
        return groups.join(_bounded(large, large.count(), broadcast_rows), "group", "left").withColumn("fits", F.col("fits").isNull())

    def one_cell(groups: DataFrame) -> DataFrame:
        return groups.filter("fits").select(
            F.col("group").alias("hub"), "sid", F.lit(None).cast("long").alias("class"), F.lit(1).cast("long").alias("blocks"), F.lit(0).cast("long").alias("block")
        )

    def laid(cells: DataFrame, n: int, values: DataFrame, keys: tuple, *more: str) -> DataFrame:
        joined = values.join(_bounded(cells.withColumnRenamed("sid", "short"), n, broadcast_rows), "short")
        return joined.select("hub", "block", "blocks", "sid", "set", "class", *more).repartition(*keys).sortWithinPartitions(*keys)

    def searched(placed: DataFrame, values: DataFrame, exact: bool, strays: bool = True) -> DataFrame:
        """Links found in blocks, and between members that their block doesn't link to the hub and all other blocks."""
        at = laid(placed, placed.count(), values, ("hub", "block"))
        found = cut(at.mapInArrow(_cells(percent, exact), "hub long, block long, a binary, b binary"), "links" if exact else "meetings")
        links = found.filter("b is not null").select("a", "b")
        lone = found.filter("b is null").select("hub", F.col("block").alias("home"), _short_column("a").alias("sid"))
        if not strays or not lone.limit(1).count():
            return links
        large = placed.filter("blocks > 1")
        per = lone.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
        moving = lone.join(per, "hub").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
        counted = large.groupBy("hub").agg(F.max("blocks").alias("blocks"))
        moving = moving.join(counted, "hub").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        moving = moving.filter("block <> home").select("hub", "block", "part", "sid", "home")
        staying = large.join(per, "hub").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        staying = staying.select("hub", "block", "part", "sid", F.col("block").alias("home"))
        both = cut(moving.unionByName(staying).distinct(), "cell-strays").withColumnRenamed("part", "blocks").withColumn("class", F.lit(None).cast("long"))
        at = laid(both, both.count(), values, ("hub", "block", "blocks"), "home")
        more = cut(at.mapInArrow(_crossing(percent, exact), "hub long, block long, a binary, b binary"), "more-links")
        return links.unionByName(more.select("a", "b"))

    # Signatures first. Sets whose hubs connect them form a group; a group that fits a block is one cell, and each
    # signature moves once. Only larger groups are dealt by hub.
    none = F.lit(None).cast("long").alias("class")
    groups = cut(components(members, "sid", "hub").withColumnsRenamed({"node": "sid", "component": "group"}), "cell-groups")
    groups = grouped(groups, SIGNATURE_BYTES)
    large = members.join(groups.filter(~F.col("fits")).select("sid"), "sid", "left_semi").select("sid", "hub", "n", "sets", none)
    placed = cut(one_cell(groups).unionByName(dealt(large, SIGNATURE_BYTES)), "cell-members")
    meetings = searched(placed, source(None, False), False)
    # Sets that may link form groups again; only these sets move, and in a group of one block each moves once.
    groups = components(meetings.select(_short_column("a").alias("a"), _short_column("b").alias("b")), "a", "b")
    groups = cut(grouped(groups.withColumnsRenamed({"node": "sid", "component": "group"}), 8), "groups")
    placed = one_cell(groups)
    links = searched(cut(placed, "cell-members"), source(placed, True), True)
    large = groups.filter(~F.col("fits")).select("sid", "group")
    if not large.limit(1).count():
        return links
    # In larger groups, a set first meets the hub that most sets share with it; where its other hubs have sets that
    # aren't connected with it by then, those cells are searched, too.
    cells = cut(members.join(large, "sid"), "large-members")
    head = cells.groupBy("group", "hub").agg(F.min(F.struct(F.col("sid") != F.col("hub"), "sid"))["sid"].alias("head"), F.count("*").alias("met"))
    cells = cells.join(head, ["group", "hub"]).select("sid", F.col("head").alias("hub"), "met", "n", "sets")
    cells = cut(cells.groupBy("sid", "hub", "n", "sets").agg(F.max("met").alias("met")), "large-cells")
    first = cells.groupBy("sid").agg(F.max(F.struct("met", "hub"))["hub"].alias("hub"))
    first = first.unionByName(first.select(F.col("hub").alias("sid"), "hub")).distinct()
    values = source(large, True)
    near = searched(cut(dealt(first.join(sizes, "sid").select("sid", "hub", "n", "sets", none), 8), "cell-members"), values, True, strays=False)
    classes = components(near.select(_short_column("a").alias("a"), _short_column("b").alias("b")), "a", "b").withColumnsRenamed({"node": "sid", "component": "class"})
    cells = cells.drop("met").join(classes, "sid", "left")
    # A short name that two sets share stands for neither.
    cells = cut(cells.select("sid", "hub", "n", "sets", F.when(F.col("sets") == 1, F.coalesce("class", "sid")).alias("class")), "large-classes")
    mixed = cells.groupBy("hub").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count_if(F.col("class").isNull()).alias("unsure"))
    mixed = mixed.filter("low <> high OR unsure > 0").select("hub")
    left = cells.join(mixed, "hub", "left_semi")
    links = links.unionByName(near)
    if not left.limit(1).count():
        return links
    return links.unionByName(searched(cut(dealt(left, 8), "cell-members"), source(left, True), True))


def _short_column(name: str):
    """The first eight bytes of a set's name as a number, little end first."""
    digits = F.hex(F.substring(name, 1, 8))
    turned = F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))
    return F.conv(turned, 16, -10).cast("long")
