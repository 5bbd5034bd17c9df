"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling hash of the last 32 bytes says so, so that a passage shared by documents gives the
same chunks wherever it stands. Each worker encodes a chunk once and keeps the ids (a cache of bounded bytes). Chunk joins
are then repaired: the text from the last safe place before a join to the first safe place after it is encoded again, and
the window grows over whole chunks until its ends fall on token boundaries of both neighbours. A place between a
character that isn't white space and a space or line end is safe: no pre-token of a byte-level vocabulary
crosses it, and what stands before it has no say in what follows. The ids are thus those of the whole text.

Everything happens in place: there is no shuffle, and memory is bounded by the cache, a batch and the longest text.

The vocabulary file stays where it is and is read by each worker from ``path`` (a parameter). Merges that are in the order
of their ids are run by a fast encoder over the same ranks; other vocabularies by the tokenizers library itself.

Defined cases: a null text counts as empty and has no ids; special tokens' strings in a text become their ids, as the
library does; an empty table gives an empty result; repeated rows each get their ids. Other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import lean, ship, text_of

WINDOW, LEAST, MOST, MASK_BITS = 32, 256, 8192, 11
ENTRY = 500  # bytes of a cache entry besides its text and ids
_gear = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
# Bytes after which a space or line end is a safe place to cut: visible ASCII.
_visible = np.zeros(256, dtype=bool)
_visible[0x21:0x7F] = True
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, 0x0A]] = True


def byte_alphabet() -> dict[str, int]:
    """The byte for each character in which byte-level vocabularies are written."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return table


class Codec:
    """Encodes and decodes with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, cache_bytes: int = 32 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = {t: i for t, i in model["vocab"].items() if t not in special} if isinstance(model.get("vocab"), dict) else {}
        self.byte_level = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and all(c in alphabet for t in plain for c in t)
            and not any(c.isspace() for t in special for c in t)  # one that holds a space could be cut at a safe place
        )
        self.fast, self.bytes_of = None, None
        if self.byte_level:
            merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            ids = [plain[t] for t in merged]
            ranks = {bytes(alphabet[c] for c in t): i for t, i in plain.items()}
            self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
            for b, i in ranks.items():
                self.bytes_of[i] = b
            for t, i in special.items():
                self.bytes_of[i] = t.encode()
            in_order = all(a < b for a, b in zip(ids, ids[1:])) and all(bytes([b]) in ranks for b in range(256)) and not model.get("ignore_merges")
            if in_order and len(merged) + 256 == len(plain) and all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", [])):
                import tiktoken

                self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.cache: OrderedDict[bytes, tuple] = OrderedDict()
        self.cached, self.cache_bytes = 0, cache_bytes
        self.hits = self.misses = 0

    @cached_property
    def library(self):
        """The library's own tokenizer, loaded where it is needed."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def plain(self, text: str) -> list[int]:
        """The ids of a text, without reuse."""
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its matcher runs out of room, as in a very long run of white space
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def _chunk(self, raw: bytes) -> tuple[array, int, int, int, int]:
        """ids; the first and last safe places in bytes (-1: none) and their places among the ids."""
        if (found := self.cache.get(raw)) is not None:
            self.cache.move_to_end(raw)
            self.hits += 1
            return found
        self.misses += 1
        ids = self.plain(raw.decode("utf-8"))
        first = last = at_first = at_last = -1
        b = np.frombuffer(raw, dtype=np.uint8)
        if len(safe := np.flatnonzero(_visible[b[:-1]] & _blank[b[1:]])):
            first, last = int(safe[0]) + 1, int(safe[-1]) + 1
            ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
            at_first, at_last = (int(np.searchsorted(ends, x)) for x in (first, last))
            if ends[at_first] != first or ends[at_last] != last:  # not a token boundary: the window goes on
                first = last = -1
        found = (array("i", ids), first, last, at_first, at_last)
        self.cache[raw] = found
        self.cached += len(raw) + 4 * len(ids) + ENTRY
        while self.cached > self.cache_bytes and len(self.cache) > 1:
            old, (old_ids, *_) = self.cache.popitem(last=False)
            self.cached -= len(old) + 4 * len(old_ids) + ENTRY
        return found

    def encode(self, text: str) -> list[int]:
        if not self.byte_level:
            return self.plain(text)
        raw = text.encode("utf-8")
        cuts = cut_places(raw)
        if len(cuts) == 0:
            return list(self._chunk(raw)[0]) if raw else []
        bounds = [0, *cuts, len(raw)]
        out: list[int] = []
        pending = 0  # bytes from here on are not yet in out
        for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
            ids, first, last, at_first, at_last = self._chunk(raw[a:z])
            if k == 0:
                if last >= 0:
                    out += ids[:at_last]
                    pending = last
            elif first >= 0:
                out += self.plain(raw[pending : a + first].decode("utf-8"))
                if k < len(bounds) - 2:
                    out += ids[at_first:at_last]
                    pending = a + last
                else:
                    out += ids[at_first:]
                    pending = z
        if pending < len(raw):
            out += self.plain(raw[pending:].decode("utf-8"))
        return out

    def decode(self, ids: list[int]) -> str:
        if self.bytes_of is None:
            return self.library.decode(ids, skip_special_tokens=False)
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


# Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut_places(raw: bytes) -> list[int]:
    """Where a text is cut: the rolling hash's places, at least LEAST and at most MOST bytes apart, between characters."""
    if len(raw) <= LEAST:
        return []
    b = np.frombuffer(raw, dtype=np.uint8)
    found: list[np.ndarray] = []
    step = 1 << 20
    for start in range(0, len(b), step):
        piece = b[max(0, start - WINDOW) : start + step]
        h = _gear[piece]
        width = 1
        while width < WINDOW:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width % 32))
            width *= 2
        hit = (h & np.uint32((1 << MASK_BITS) - 1) << np.uint32(32 - MASK_BITS)) == 0
        hit[:-1] &= (piece[1:] & 0xC0) != 0x80  # the next byte begins a character
        places = np.flatnonzero(hit) + 1 + max(0, start - WINDOW)
        found.append(places[(places > start) & (places < len(b))])
    out, at = [], 0
    for p in np.concatenate(found).tolist() + [len(raw)]:
        while p - at > MOST:
            q = at + MOST
            while q < len(raw) and (raw[q] & 0xC0) == 0x80:
                q += 1
            if q >= p:
                break
            out.append(q)
            at = q
        if p - at >= LEAST and len(raw) - p >= LEAST:
            out.append(p)
            at = p
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            keys, ids, size, begun = batch.column(0), [], 0, 0
            for k in range(batch.num_rows):
                own = np.array(c.encode(batch.column(1)[k].as_py()), dtype=np.int32)
                ids.append(own)
                size += len(own)
                if size >= chunk or k == batch.num_rows - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, k + 1 - begun), lists], ["id", "ids"])
                    ids, size, begun = [], 0, k + 1

    return lean(run)


def _decode(path: str, kinds: list, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at, step = 0, max(1, min(512, batch.num_rows))
            while at < batch.num_rows:
                part = batch.slice(at, step)
                texts = [c.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])
                at += step

    return lean(run)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 20) -> DataFrame:
    """id and ``ids``: the token ids of every whole text."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = base.mapInArrow(_encode(path, chunk), f"id {base.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", chunk: int = 1 << 20) -> DataFrame:
    """id, ``ids`` and ``decoded``: the text of the ids, special tokens included."""
    ship(encoded.sparkSession)
    base = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = base.mapInArrow(_decode(path, [], chunk), f"id {base.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def bpe_append(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of its text and their decoded text as further columns (in place of columns so named)."""
    ship(docs.sparkSession)
    base = docs.drop(ids_col, decoded_col)
    place = len(base.columns)
    names = [f"c{k}" for k in range(place)]
    laid = base.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(base.columns, names)), text_of(text_col).alias("t"))
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, base.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [c.encode(t.as_py()) for t in part.column(place)]
                out = [*part.columns[:place], pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*names, "ids", "decoded"])

    out = laid.mapInArrow(lean(run), f"{fields}, ids array<int>, decoded string")
    return out.toDF(*base.columns, ids_col, decoded_col)
