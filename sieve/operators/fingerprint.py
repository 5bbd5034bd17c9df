"""Exact and near fingerprints of messages, and near-duplicate pairs by bands of the near fingerprint."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions.hashing import fnv64_all, hamming
from sieve.functions.text import TOKEN, fingerprint_text, tokens

MOST_TOKENS = 8000


def exact_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the normalised parts, joined by line ends."""
    return F.sha2(fingerprint_text(F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts))), 256)


def content_key(*fields: Column, label: Column | None = None) -> Column:
    """SHA-256 of cleaned, lower-cased fields; without the label unless it is given (an older, faulty policy)."""
    clean = [F.trim(F.regexp_replace(F.lower(F.coalesce(f, F.lit(""))), r"\s+", " ")) for f in fields]
    return F.sha2(F.concat_ws("\n", *([label.cast("string")] if label is not None else []), *clean), 256)


def _votes(codes: np.ndarray, rows: np.ndarray, hashes: np.ndarray, n_rows: int, weighted: bool) -> np.ndarray:
    """For each row the signs of its tokens' votes; ``codes`` are places in ``hashes``."""
    out = np.zeros(n_rows, dtype=np.uint64)
    if not len(codes):
        return out.view(np.int64)
    pairs, counts = np.unique(rows * len(hashes) + codes, return_counts=True)
    if weighted:
        counts = np.minimum(counts, 4)
    row, code = np.divmod(pairs, len(hashes))
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    own, counts = hashes[code], counts.astype(np.int64)
    bits = np.zeros(len(begins), dtype=np.uint64)
    for b in range(64):
        vote = np.where((own >> np.uint64(b)) & np.uint64(1), counts, -counts)
        bits |= (np.add.reduceat(vote, begins) >= 0).astype(np.uint64) << np.uint64(b)
    out[row[begins]] = bits
    return out.view(np.int64)


def simhash(words: Column, weighted: bool = False) -> Column:
    """The near fingerprint of an array of tokens: for each bit, the sign of the tokens' votes; ties are 1, no tokens 0.

    It depends on its row alone: nothing is shuffled. Distinct tokens of a batch are hashed once.
    """

    @F.pandas_udf(T.LongType())
    def batch(lists: pd.Series) -> pd.Series:
        out = np.empty(len(lists), dtype=np.int64)
        for start in range(0, len(lists), 1024):
            part = [x if x is not None else () for x in lists.iloc[start : start + 1024]]
            rows = np.repeat(np.arange(len(part), dtype=np.int64), [len(x) for x in part])
            codes, names = pd.factorize(np.concatenate([np.asarray(x, dtype=object) for x in part]) if len(rows) else np.empty(0, dtype=object))
            out[start : start + len(part)] = _votes(codes, rows, fnv64_all(list(names)).view(np.uint64), len(part), weighted)
        return pd.Series(out)

    return batch(words)


def near_fingerprint(docs: DataFrame, key: str, text: Column, weighted: bool = False, most: int = MOST_TOKENS) -> DataFrame:
    """(key, simhash) of each row, by the tokens of its normalised text. With ``weighted`` a token votes by its count, at most 4."""
    return docs.select(F.col(key), simhash(tokens(fingerprint_text(text), TOKEN, most), weighted).alias("simhash"))


def bands(hashes: DataFrame, column: str = "simhash", parts: int = 4) -> DataFrame:
    """Each row once for each 16-bit band: (…, part, band)."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1).cast("long")
    cut = F.array(*(F.struct(F.lit(p).alias("part"), F.shiftrightunsigned(F.col(column), p * width).bitwiseAND(mask).alias("band")) for p in range(parts)))
    return hashes.withColumn("__b", F.explode(cut)).select("*", "__b.part", "__b.band").drop("__b")


def near_pairs(hashes: DataFrame, most_distance: int = 2, column: str = "simhash") -> DataFrame:
    """(a, b, distance) of distinct fingerprints, a < b, at most ``most_distance`` bits apart: complete up to 3.

    Distinct fingerprints are joined on bands, so copies and texts without tokens don't multiply.
    """
    distinct = bands(hashes.select(F.col(column).alias("h")).distinct(), "h")
    left, right = distinct.select("part", "band", F.col("h").alias("a")), distinct.select("part", "band", F.col("h").alias("b"))
    close = left.join(right, ["part", "band"]).filter("a < b").withColumn("distance", hamming(F.col("a"), F.col("b")))
    return close.filter(F.col("distance") <= most_distance).select("a", "b", "distance").distinct()


def near_copies(hashes: DataFrame, key: str, most_distance: int = 2, column: str = "simhash") -> DataFrame:
    """(a, b, distance) of keys, a < b: each row with the first of its fingerprint at distance 0, and first rows of near fingerprints.

    Rows of equal fingerprints name their first one only, so copies don't multiply; two rows are near if their firsts are
    the same or a pair. Complete up to 3.
    """
    hashes = hashes.select(F.col(key).alias("b"), F.col(column).alias("h")).repartition("h")  # all uses below read this one exchange
    first = hashes.groupBy("h").agg(F.min("b").alias("a"))
    same = hashes.join(first, "h").filter(~F.col("b").eqNullSafe(F.col("a"))).select("a", "b", F.lit(0).alias("distance"))
    cut = bands(first, "h")
    left, right = cut.select("part", "band", F.col("h").alias("h1"), F.col("a").alias("a1")), cut.select("part", "band", F.col("h").alias("h2"), F.col("a").alias("a2"))
    close = left.join(right, ["part", "band"]).filter("h1 < h2").withColumn("distance", hamming(F.col("h1"), F.col("h2"))).filter(F.col("distance") <= most_distance)
    return same.unionByName(close.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"), "distance").distinct())
