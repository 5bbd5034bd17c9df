"""Word shingles as sets of 64-bit numbers, computed a batch of texts at a time.

Words are runs of bytes other than the six ASCII white-space characters, A-Z lower-cased. A word's number is a
polynomial of its bytes modulo 2^64, then mixed; a shingle's number is mixed from its words'. Words of over PIECE bytes
get theirs from BLAKE2. A text is worked through in pieces, so memory follows its words, not several times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
U = np.uint64
_space = np.zeros(256, dtype=bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64), 7) | U(1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            table = np.ones(PIECE + 1, dtype=np.uint64)
            size = 1
            while size < len(table):  # doubling: the next powers are the ones so far times base^size
                n = min(size, len(table) - size)
                table[size : size + n] = table[:n] * U(pow(base, size, 1 << 64))
                size += n
            _tables[name] = table
    return _tables["up"], _tables["down"]


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and starts of the words of a lower-cased buffer of at most PIECE bytes."""
    up, down = _powers()
    b = np.frombuffer(buffer, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_space[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + U(1)) * up[: len(b)], out=sums[1:])
    numbers = (sums[ends] - sums[starts]) * down[starts]
    return mix(numbers + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            back = max(raw.rfind(c, at, end) for c in _SPACES)
            if back >= 0:
                end = back + 1
            else:  # one long word
                forward = [p for c in _SPACES if (p := raw.find(c, end)) >= 0]
                end = min(forward) if forward else len(raw)
        yield raw[at:end]
        at = end


def _long_words(raw: bytes) -> np.ndarray:
    out = []
    for piece in _pieces(raw):
        if len(piece) > PIECE:
            digest = hashlib.blake2b(piece.strip(b"".join(_SPACES)), digest_size=8).digest()
            out.append(np.frombuffer(digest, dtype=np.uint64))
        else:
            out.append(_words(piece)[0])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def word_numbers(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The word numbers of each text, in order."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        sizes = np.array([len(x) + 1 for x in group])
        numbers, starts = _words(b"\n".join(group))
        bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        for a, z in zip(bounds[:-1], bounds[1:]):
            yield numbers[a:z]
        group.clear()

    for raw in texts:
        raw = raw.lower()  # of bytes: A-Z only
        if len(raw) >= PIECE // 2:
            yield from flush()
            size = 0
            yield _long_words(raw)
            continue
        if size + len(raw) + 1 > PIECE:
            yield from flush()
            size = 0
        group.append(raw)
        size += len(raw) + 1
    yield from flush()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles; with fewer words than width, the whole sequence as one; without words, none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix((words * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + U(n), 3)
    total = words[: n - width + 1] * _FACTORS[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * _FACTORS[k]
    return np.unique(mix(total, 5))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    n = len(shingles)
    a = mix(mix(shingles, 11).sum(dtype=np.uint64, keepdims=True) + U(n), 12)
    b = mix(mix(shingles, 13).sum(dtype=np.uint64, keepdims=True) ^ U(n * 0x9E3779B1), 14)
    return a.tobytes() + b.tobytes()
