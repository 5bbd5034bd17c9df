"""TF-IDF of every term of every text, without a shuffled row for each document and term.

A task cuts its texts into chunks. Of a chunk travel its words as numbers, and of each distinct term a digest and a count, to the
task that adds the counts of a range of digests. The sums return to the chunk, which then makes its rows.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a chunk's words, bytes of text for a range of digests (at least, at most), and rows returned at a time.
CHUNK, RANGE, ROWS = 1 << 23, (1 << 20, 1 << 24), 1 << 15
KEYS, SIZES, WORDS, CODES = -4, -3, -2, -1  # places of a chunk's parts; its counts stand at their range


def _pack(values: pa.Array) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([values], ["v"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(data.as_buffer()).read_all().column(0).combine_chunks()


def _planes(*columns: np.ndarray) -> bytes:
    """Numbers as all their first bytes, all their second ones and so on, which packs well."""
    return _pack(pa.array(np.concatenate([c.view(np.uint8).reshape(len(c), c.itemsize).T.ravel() for c in columns])))


def _numbers(data: pa.Scalar, *kinds: type) -> list[np.ndarray]:
    flat, out, at = _unpack(data).to_numpy(zero_copy_only=False), [], 0
    wide = [np.dtype(k).itemsize for k in kinds]
    n = len(flat) // sum(wide)
    for kind, w in zip(kinds, wide):
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Murmur3's last step, 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grams(sizes: np.ndarray, codes: np.ndarray, words: int, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(row, term) of each occurrence of grams of up to n words, and of each longer length the distinct (shorter gram, last word).

    Terms are numbered from the words on, length by length.
    """
    words = max(words, 1)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    at, ids, first = np.arange(len(codes)), codes, 0
    rows, terms, longer = [row], [codes], []
    for k in range(2, n + 1):
        keep = at + k - 1 < len(codes)
        at, ids = at[keep], ids[keep]
        keep = row[at] == row[at + k - 1]
        at, ids = at[keep], ids[keep]
        known, ids = np.unique(ids * words + codes[at + k - 1], return_inverse=True)
        first += len(longer[-1][0]) if longer else words
        longer.append(np.divmod(known, words))
        rows.append(row[at])
        terms.append(ids + first)
    return np.concatenate(rows), np.concatenate(terms), longer


def _counted(at: np.ndarray, terms: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf), in order of row and term; overwrites the rows in ``at``, which saves the worker's memory."""
    at *= distinct
    at += terms
    at.sort()
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    return *np.divmod(at[begins], distinct), np.diff(begins, append=len(at))


def _digests(words: pa.Array, longer: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 and 16 bits for each term, the same in every chunk."""
    own = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.cast(pa.large_binary()).to_pylist())
    lanes = np.frombuffer(own or bytes(16), dtype=np.uint64).reshape(-1, 2)  # without words, one that nothing has
    out = []
    for lane in lanes.T:
        found = [lane]
        for shorter, last in longer:
            found.append(_mixed(_mixed(found[-1] + np.uint64(0x9E3779B97F4A7C15))[shorter] + lane[last]))
        out.append(np.concatenate(found))
    return out[0], (out[1] >> np.uint64(48)).astype(np.uint16)


def _in_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    order = np.argsort(high)
    near = high[order]
    return np.lexsort((low, high)) if (near[1:] == near[:-1]).any() else order


def _chunk(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """(keys, words of each row, distinct words, code of each word)."""
    keys = pa.concat_arrays([b.column(0) for b in batches])
    lists = pc.split_pattern(pa.concat_arrays([b.column(1) for b in batches]), " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.uint32)
    coded = lists.flatten().dictionary_encode()
    return keys, sizes, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring rows until their words reach ``most`` bytes; a row is never cut."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = before = 0
        while start < batch.num_rows:
            stop = min(int(np.searchsorted(ends, before + most - size)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _freed() -> None:
    """Gives memory back between chunks: the next task of the worker, or another worker, may need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tfidf(rows: DataFrame, key: str, words: Column, n: int, docs: int, size: int, min_df: int, max_df: float, partitions: int) -> DataFrame:
    """(key, term, tfidf) as features.tfidf has it without a cap; keys must be distinct and not null.

    ``words`` is a row's array of words without spaces, ``size`` the bytes of all texts, about. A row for each chunk and range of digests is shuffled, and
    terms with equal digests of 80 bits count as equal.
    """
    ranges = max(size // RANGE[1], min(partitions, size // RANGE[0]), 1)
    most = min(CHUNK, max(RANGE[0], size // partitions))

    def of(chunk: tuple) -> tuple:
        keys, sizes, known, codes = chunk
        at, terms, longer = _grams(sizes, codes.astype(np.int64), len(known), n)
        distinct = max(len(known), 1) + sum(len(last) for _, last in longer)
        high, low = _digests(known, longer)
        order = _in_order(high, low)
        return (*_counted(at, terms, distinct), longer, high, low, order)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, held in enumerate(_cut(batches, most)):
            chunk = keys, sizes, known, codes = _chunk(held)
            _, terms, _, _, high, low, order = of(chunk)
            high, low, df = high[order], low[order], np.bincount(terms, minlength=len(order))[order].astype(np.uint32)
            edges = np.searchsorted(((high >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), np.arange(ranges + 1))
            parts = [(-1 - (task + number), place, data) for place, data in ((KEYS, _pack(keys)), (SIZES, _planes(sizes)), (WORDS, _pack(known)), (CODES, _planes(codes)))]
            for k, (a, z) in enumerate(zip(edges, edges[1:])):
                parts.append((k, k, _planes(np.diff(high[a:z], prepend=np.uint64(0)), low[a:z], df[a:z])))
            to, place, data = zip(*parts)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((to, [task + number] * len(to), place, data), kinds)], ["to", "chunk", "place", "data"])
            del chunk, keys, sizes, known, codes, terms, high, low, order, df, parts, data
            _freed()

    def added(group: pa.Table) -> pa.Table:
        out = group.select(["chunk", "place", "data"])
        if group.column("to")[0].as_py() < 0:
            return out
        found = [_numbers(x, np.uint64, np.uint16, np.uint32) for x in group.column("data")]
        high, low, df = (np.concatenate(x) for x in zip(*((np.cumsum(h, dtype=np.uint64), w, d) for h, w, d in found)))
        if len(high):
            order = np.lexsort((low, high))
            new = np.append(True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0))
            total = np.add.reduceat(df[order].astype(np.int64), np.flatnonzero(new))
            total[(total < min_df) | (total > max_df * docs)] = 0  # not in the vocabulary
            df = np.empty(len(order), dtype=np.int64)
            df[order] = total[np.cumsum(new) - 1]
        edges = np.cumsum([0, *(len(h) for h, _, _ in found)])
        return out.set_column(2, "data", pa.array([_planes(df[a:z].astype(np.int64)) for a, z in zip(edges, edges[1:])], pa.binary()))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {p.as_py(): d for b in batches for p, d in zip(b.column("place"), b.column("data"))}
        keys, known = _unpack(parts.pop(KEYS)), _unpack(parts.pop(WORDS))
        (sizes,), (codes,) = (_numbers(parts.pop(k), np.uint32) for k in (SIZES, CODES))
        df = np.concatenate([_numbers(parts[k], np.int64)[0] for k in sorted(parts)])
        at, terms, tf, longer, _, _, order = of((keys, sizes, known, codes))
        idf = np.zeros(len(order))
        idf[order] = np.where(df > 0, np.log((1.0 + docs) / (1.0 + df)) + 1, 0)
        keep = idf[terms] > 0
        at, terms, tf = at[keep], terms[keep], tf[keep]
        w = (1 + np.log(tf)) * idf[terms]
        w /= np.sqrt(np.bincount(at, weights=w * w, minlength=len(keys)))[at]
        known = known.cast(pa.large_string())
        names, named = [known], np.ones(len(order), dtype=bool)
        if longer:  # no gram is made of the longest ones: only those of the vocabulary are named
            named[len(order) - len(longer[-1][0]) :] = held = idf[len(order) - len(longer[-1][0]) :] > 0
            longer[-1] = tuple(x[held] for x in longer[-1])
        for shorter, last in longer:
            names.append(pc.binary_join_element_wise(names[-1].take(pa.array(shorter)), known.take(pa.array(last)), pa.scalar(" ", pa.large_string())))
        names, terms = pa.concat_arrays(names), (np.cumsum(named) - 1)[terms]
        for a in range(0, len(w), ROWS):
            z = slice(a, a + ROWS)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[z])), names.take(pa.array(terms[z])).cast(pa.string()), pa.array(w[z])], [key, "term", "tfidf"])
        del keys, names, at, terms, tf, w, idf, df, order, codes, parts
        _freed()

    kind = rows.schema[key].dataType.simpleString()
    moved = rows.select(key, F.nullif(F.array_join(words, " "), F.lit("")).alias("words")).mapInArrow(sent, "to bigint, chunk bigint, place int, data binary")
    summed = moved.groupBy("to").applyInArrow(added, "chunk bigint, place int, data binary")
    return summed.groupBy("chunk").applyInArrow(weighed, f"`{key}` {kind}, term string, tfidf double")
