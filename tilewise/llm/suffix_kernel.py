"""Sampled suffixes of texts, and the strings they stand for, as Arrow batches.

A string of ``length`` bytes is represented by one suffix position inside it: the place of
its least-hashed gram (a third of its length). Consecutive strings mostly share that
place, so a text is covered by few sampled suffixes, each with the range of string starts
it stands for. Equal strings choose the same relative place, hence have suffixes that
agree in the gram at least.
"""

from __future__ import annotations

import numpy as np

from tilewise.llm import textkernel as tk

#: Bytes of a string that must not repeat.
LENGTH = 400


def gram_of(length: int) -> int:
    return max(16, length * 8 // 25)


def heads(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes from each place on, as two numbers that sort as the bytes do."""
    first = data[at[:, None] + np.arange(16)].view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    return first[:, 0].view(np.int64), first[:, 1].view(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block-wise running minima."""
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    right = np.minimum.accumulate(full, axis=1).reshape(-1)
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, count, head, tail, gram, mark) of the sampled suffixes of a run of texts.

    The strings start at ``start .. start + count - 1`` of the text; ``head`` and ``tail``
    are the suffix's first 16 bytes, ``gram`` hashes its gram, ``mark`` all bytes of the
    strings and where the gram stands in them.
    """
    n, gram = len(data), gram_of(length)
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 7
    prefix = tk.prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = tk.span_hash(prefix, at, at + gram)
    place = sliding_min((grams & tk.U(0xFFFFFFFF00000000)) | at.astype(tk.U), length - gram + 1) & tk.U(0xFFFFFFFF)
    valid = np.zeros(n + 1, np.int64)
    sizes = np.diff(offsets)
    big = sizes >= length
    valid[offsets[:-1][big]] += 1
    np.add.at(valid, offsets[1:][big] - length + 1, -1)
    ok = np.cumsum(valid)[: len(place)] > 0
    new = np.zeros(len(place), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
    new[offsets[:-1][big]] = True
    first = np.nonzero(new & ok)[0]
    if not len(first):
        return (none,) * 7
    stop = np.nonzero(np.concatenate([(new | ~ok)[1:], [True]]) & ok)[0] + 1
    count = stop - first
    anchor = place[first].astype(np.int64)
    text = tk.owner(first, offsets)
    mark = tk.splitmix(tk.span_hash(prefix, first, stop - 1 + length) + (anchor - first).astype(tk.U))
    return text, first - offsets[text], count, *heads(data, anchor), grams[anchor].astype(np.int64), mark.astype(np.int64)
