"""Text helpers for Arrow batches: words, hashes and shingles of many texts at once.

All functions work on the UTF-8 bytes of whole texts with numpy; a null text counts as
empty. A *piece* is a run of consecutive rows of a batch with a bounded number of bytes
(one longer text is a piece of its own), so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_000_000
SHINGLE_WORDS = 5

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); different seeds give independent hashes."""
    z = x + _U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
    z ^= z >> _U(30)
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


def mix_int(x: int, seed: int = 0) -> int:
    return int(mix(np.array([x % 2**64], np.uint64), seed)[0])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(21, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = _U(pow(base, done, 2**64))
                p[done : 2 * done] = p[:done] * step
                done *= 2
            both.append(p)
        _powers[size] = (both[0], both[1])
    return _powers[size]


_POINT_CODE = mix(np.arange(0x3000, dtype=np.uint64), 5)


def code_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit code for every code point."""
    if len(points) and points.max() >= len(_POINT_CODE):
        return mix(points.astype(np.uint64), 5)
    return _POINT_CODE[points]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of codes[start:end] for every span."""
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` bytes, at least one row each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-separators that stays in one text,
    and, for each text, the index of its first word (n + 1 entries)."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and each text's first word."""
    start, end, first = split_words(data, offsets)
    return span_hashes(BYTE_CODE[_LOWER[data]], start, end), first


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text, its distinct shingle hashes in ascending order: ``size`` consecutive
    words each; fewer words make one shingle, no word makes none."""
    n = max(0, len(words) - size + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(size):
        grams += words[j : j + n] * _U(mix_int(j, 90) | 1)
    grams = mix(grams, 91)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for j in range(a, b):
                h = mix(h ^ words[j : j + 1], j - a + 1)
            yield mix(h, 100 + b - a)
        else:
            yield np.empty(0, np.uint64)


def set_key(elements: np.ndarray) -> int:
    """A signed 64-bit key of a set of distinct hashes; independent of their order."""
    total = int(np.add.reduce(mix(elements, 77))) if len(elements) else 0
    return to_signed(mix_int(total + len(elements), 78))


def to_signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x
