"""Vectorised byte-level text measures for Arrow batches.

All functions work on the concatenated UTF-8 bytes of a run of texts, so the cost
per document is a few NumPy operations. Word rules of the operators are stated on
ASCII delimiters only, hence bytes of multi-byte characters are plain word bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are taken in runs of about this many bytes (a longer text is its own run).
RUN_BYTES = 1 << 18

#: `[^\x20\x09-\x0D]+`
SPACE_DELIMS = np.zeros(256, bool)
SPACE_DELIMS[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM_DELIMS = np.zeros(256, bool)
ALNUM_DELIMS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = splitmix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = splitmix(np.arange(1, 65, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


class Powers:
    """Powers of the hash base and of its inverse; those for a very long text aren't kept."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            m = max(n + 1, RUN_BYTES)
            up, down = np.full(m, _BASE, U), np.full(m, _INVERSE, U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
            if m > 16 * RUN_BYTES:
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of consecutive texts of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the (unnormalised) polynomial hash of bytes i..j-1."""
    out = np.zeros(len(data) + 1, U)
    up, _ = Powers.of(len(data))
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    _, down = Powers.of(len(prefix) - 1)
    return splitmix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * _STEP[63])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.nonzero(start)[0], np.nonzero(end)[0] + 1


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte measure over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(position: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text in which each byte position stands (texts may be empty)."""
    return np.searchsorted(offsets, position, "right") - 1


def windows(word_hash: np.ndarray, word_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word index, hash) of every window of k words inside one text."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.nonzero(word_text[:n] == word_text[k - 1 :])[0]
    total = np.zeros(len(at), U)
    for i in range(k):
        total += word_hash[at + i] * _STEP[i]
    return at, splitmix(total + _STEP[62:63] * U(k))


def word_hashes(data: np.ndarray, offsets: np.ndarray, delims: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index, hash) of each word."""
    if lower:
        data = LOWER[data]
    start, end = spans(~delims[data], offsets)
    return start, end, owner(start, offsets), span_hash(prefix_hash(data), start, end)
