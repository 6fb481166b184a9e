"""Vectorised word and shingle hashing over UTF-8 buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes, with A-Z
lower-cased.  All hashing happens on whole buffers with numpy: a word's hash is
a polynomial over its bytes modulo 2**64, read off a prefix sum, and finished
with a 64-bit mixer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes hashed at a time; bounds the memory of the prefix sums.
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FACTORS = _RNG.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 0x41) & (code <= 0x5A)
    word = (code >= 0x80) | ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A)) | upper
    values = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
    values[upper] = values[code[upper] + 32]
    return word, values


_IS_WORD, _VALUES = _tables()
#: Bytes of a token: anything but ASCII white space.
IS_TOKEN = ~np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; only the longest are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // (1 << 16)) << 16
        forth, back = np.full(size, _BASE), np.full(size, _BASE_INV)
        forth[0] = back[0] = 1
        _POWERS[:] = np.multiply.accumulate(forth), np.multiply.accumulate(back)
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first = int(offsets[0]) if len(offsets) else 0
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[first : int(offsets[-1])], offsets - first


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least."""
    _, offsets = buffers(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, len(texts))
        start = end


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a buffer and, for each row, the offset of its first word.

    inside tells for each byte whether it belongs to a word.
    """
    out: list[np.ndarray] = []
    starts_at: list[np.ndarray] = []
    flags = inside[raw]
    ends = offsets[1:-1]
    n, begin = len(raw), 0
    while begin < n:
        end = min(n, begin + CHUNK_BYTES)
        while end < n and flags[end - 1] and flags[end]:  # a chunk ends between words
            stop = np.flatnonzero(~flags[end : end + CHUNK_BYTES])
            end = min(n, end + (int(stop[0]) if len(stop) else CHUNK_BYTES))
        flag = flags[begin:end]
        change = np.empty(len(flag) + 1, bool)
        change[0], change[-1] = flag[0], flag[-1]
        np.not_equal(flag[1:], flag[:-1], out=change[1:-1])
        inner = ends[(ends > begin) & (ends < end)] - begin
        cut = inner[flag[inner] & flag[inner - 1]]  # a row ends where the next begins with a word
        edges = np.flatnonzero(change)
        if len(cut):
            edges = np.sort(np.concatenate([edges, np.repeat(np.unique(cut), 2)]))
        s, e = edges[0::2], edges[1::2]
        forth, back = _powers(len(flag) + 1)
        sums = np.zeros(len(flag) + 1, np.uint64)
        np.cumsum(_VALUES[raw[begin:end]] * forth[: len(flag)], out=sums[1:])
        out.append(mix64((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)))
        starts_at.append(s + begin)
        begin = end
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    at = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return hashes, np.searchsorted(at, offsets, "left")


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words of a row, and each row's offset into them.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(first)
    per_row = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_row, out=at[1:])
    row = np.repeat(np.arange(len(counts)), per_row)
    begin = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    size = np.minimum(counts, n)[row]
    total = size.astype(np.uint64)
    for k in range(n):
        has = size > k
        total += np.where(has, hashes[np.where(has, begin + k, 0)] if len(hashes) else np.uint64(0), np.uint64(0)) * _FACTORS[k]
    return mix64(total), at
