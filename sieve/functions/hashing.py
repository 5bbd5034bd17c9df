"""Hashes as JVM expressions, and over whole batches of names. Characters are UTF-16 units, surrogate pairs included."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a offsets and primes.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211


def _units(c: Column) -> Column:
    """UTF-16 units; empty for the empty string. Letters beyond the basic plane are two, a high and a low surrogate."""
    codes = F.filter(F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long")), lambda x: x > 0)
    high = lambda x: F.shiftright(x - 0x10000, 10) + 0xD800
    low = lambda x: (x - 0x10000).bitwiseAND(F.lit(0x3FF).cast("long")) + 0xDC00
    units = F.flatten(F.transform(codes, lambda x: F.when(x > 0xFFFF, F.array(high(x), low(x))).otherwise(F.array(x))))
    astral = F.octet_length(c) >= F.length(c) + 3  # a letter of four bytes adds three
    some = F.when(astral, units).otherwise(codes)
    return F.when(F.length(c) > 0, some).otherwise(F.array().cast("array<bigint>"))


def fnv32(c: Column) -> Column:
    """FNV-1a, 32 bits, as a BIGINT: products stay below 2^63."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.aggregate(_units(c), F.lit(FNV32_OFFSET).cast("long"), lambda h, u: (h.bitwiseXOR(u) * FNV32_PRIME).bitwiseAND(mask))


def fnv64(c: Column) -> Column:
    """FNV-1a, 64 bits, as the BIGINT of the same bits: two 32-bit limbs, as ANSI arithmetic doesn't wrap."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    start = F.struct(F.lit(FNV64_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV64_OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))

    def step(s: Column, u: Column) -> Column:
        low = s["lo"].bitwiseXOR(u)  # the prime is 2^40 + 435
        product = low * 435
        high = (s["hi"] * 435 + low.bitwiseAND(F.lit(0xFFFFFF).cast("long")) * 256 + F.shiftright(product, 32)).bitwiseAND(mask)
        return F.struct(high.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    return F.aggregate(_units(c), start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def _fnv_all(values: list[str], offset: int, prime: int, kind: type) -> np.ndarray:
    """FNV-1a of strings over UTF-16 units; strings of a length are hashed together, a unit at a time."""
    raw = [v.encode("utf-16-le", "surrogatepass") for v in values]
    sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    out = np.full(len(raw), offset, dtype=kind)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, z in zip(edges, [*edges[1:], len(order)]):
        own = order[a:z]
        units = np.frombuffer(b"".join(raw[k] for k in own), dtype=np.uint16).reshape(len(own), -1)
        h = out[own]
        for k in range(units.shape[1]):
            h = (h ^ units[:, k].astype(kind)) * kind(prime)
        out[own] = h
    return out


def fnv64_all(values: list[str]) -> np.ndarray:
    """FNV-1a, 64 bits, of strings, as int64."""
    return _fnv_all(values, FNV64_OFFSET, FNV64_PRIME, np.uint64).view(np.int64)


def fnv32_all(values: list[str]) -> np.ndarray:
    """FNV-1a, 32 bits, of strings, as uint32."""
    return _fnv_all(values, FNV32_OFFSET, FNV32_PRIME, np.uint32)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of strings: a string's bytes begin at its edge and end at the next."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), edges


def murmur3_all(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Murmur3, 32 bits, of ranges of bytes, as int32: what pyspark.ml's HashingTF takes. Ranges of a size are hashed together."""
    sizes, out = ends - begins, np.full(len(begins), seed, dtype=np.uint32)

    def turned(h: np.ndarray, by: int) -> np.ndarray:
        return (h << np.uint32(by)) | (h >> np.uint32(32 - by))

    order = np.argsort(sizes, kind="stable")
    groups = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, z in zip(groups, [*groups[1:], len(order)]):
        own = order[a:z]
        size, first, h = int(sizes[own[0]]), begins[own], out[own]
        for at in range(0, size, 4):
            k = np.zeros(len(own), dtype=np.uint32)
            for b in range(min(4, size - at)):
                k |= data[first + (at + b)].astype(np.uint32) << np.uint32(8 * b)
            k = turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = h ^ k
            if size - at >= 4:
                h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[own] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)


@F.pandas_udf(T.LongType())
def fnv64_udf(values: pd.Series) -> pd.Series:
    return pd.Series(fnv64_all(values.fillna("").tolist()))


def blake2b_mod(buckets: int, reserve: int = 0):
    """A UDF: the 64-bit BLAKE2b of a string modulo ``buckets``, shifted past reserved ids."""

    @F.pandas_udf(T.LongType())
    def udf(values: pd.Series) -> pd.Series:
        digest = lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little")
        return values.map(lambda v: digest(v) % buckets + reserve)

    return udf


def feature_index(name: Column, dimension: int = 1 << 17) -> Column:
    """The place of a feature: FNV-1a-32 without its sign bit, modulo a power of two above 1024."""
    if dimension <= 1024 or dimension & (dimension - 1):
        raise ValueError("the dimension must be a power of two above 1024")
    return fnv32(name).bitwiseAND(F.lit(0x7FFFFFFF & (dimension - 1)).cast("long")).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def scan_key(namespace: str, raw: Column) -> Column:
    """The cache key of a scan: SHA-256 of the namespace, a line end and the raw message."""
    return F.sha2(F.concat(F.lit(namespace + "\n").cast("binary"), raw.cast("binary")), 256)


def hash_order(seed: int, *keys: Column) -> Column:
    """A reproducible order in place of a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)
