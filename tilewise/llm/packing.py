"""Sum-of-squares packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces (the first may be shorter).
Pieces are placed, longest first, where the squared counts of open bins per residual
gap become smallest; ties go to the smallest gap. This is a variant of the rule: a new bin is
opened only where none fits, so that few sequences are needed for small corpora too. Groups of bounded size are packed apart, then the bins that stayed open in
all groups are packed as wholes by the same rule, so the waste doesn't add up over groups.

Defined cases: null text is the one token that ends every document; repeated rows are
packed as documents of their own (rows are dealt to groups by row, not by id, so an id
that repeats never fills one group); null ids are carried; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm.shared import pick, stored
from tilewise.llm.token_counts import LETTERS, PLAIN, STOPS, specials, tokenizer

CAPACITY = 2048
#: Pieces that one task packs at once.
GROUP = 12_000
#: Words whose ids a Python worker remembers, at most.
MEMO_WORDS = 400_000
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: How the tokenizer parts a text of PLAIN characters; each part is encoded apart.
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
#: White space other than single spaces and single line ends: its parts depend on what follows.
UNEVEN = ("  ", " \n", "\t", "\r", "\n\n", "\n ")
#: Fixed value: the pre-tokenizer that parts texts like PARTS.
BY_PARTS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@lru_cache(maxsize=4)
def parts_apply(path: str) -> bool:
    """Whether the tokenizer's own description says that it parts plain texts like PARTS."""
    d = json.loads(tokenizer(path).to_str())
    return d["normalizer"] is None and d["pre_tokenizer"] == BY_PARTS


class _Memo(dict):
    """Ids of the words met so far, each with ``before`` in front of it; a new word is
    encoded by the library's model."""

    def __init__(self, path: str, before: str):
        super().__init__()
        self.model, self.before = tokenizer(path).model, before
        self.shown = before.translate(LETTERS)
        self.stops = {x: self.parts(x) for x in STOPS}

    def parts(self, text: str) -> bytes:
        ids = [x.id for w in PARTS.findall(text) for x in self.model.tokenize(w.encode().decode("latin-1").translate(LETTERS))]
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        if word.isascii() and word.isalpha():  # one part, and its bytes stand for themselves
            ids = array("I", [x.id for x in self.model.tokenize(self.shown + word)]).tobytes()
        elif word[-1:] in STOPS and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self.stops[word[-1]]
        else:
            ids = self.parts(self.before + word)
        self[word] = ids
        return ids


@lru_cache(maxsize=4)
def _memo(path: str, before: str) -> _Memo:
    return _Memo(path, before)


def encode(text: str, path: str) -> bytes:
    """The text's ids as the library gives them, little-endian unsigned 32-bit.

    Plain texts fall apart at single spaces and line ends, and each word (with the space
    before it) is encoded by the library's model once and remembered; other texts, and all
    texts of a tokenizer that parts them otherwise, are encoded whole.
    """
    if not parts_apply(path) or any(m in text for m in specials(path)) or not PLAIN.fullmatch(text):
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    spaced, bare = _memo(path, " "), _memo(path, "")
    if text.endswith(" ") or any(x in text for x in UNEVEN):
        return bare.parts(text)
    lines = []
    for line in text.split("\n"):
        first, *words = line.split(" ")
        lines.append(bare[first] + b"".join(map(spaced.__getitem__, words)))
    return bare["\n"].join(lines)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = encode(text or "", path) + b"\0\0\0\0"
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            edges = [0, *range(first, n + 1, capacity)]
            out += [(doc_id, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "piece", "start", "length", "ids_crc32"])


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; items are taken longest first."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; full bins are closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        gaps = np.nonzero(count[s:capacity])[0] + s
        gap = capacity
        if len(gaps):
            change = np.where(gaps > s, 2 * (count[gaps - s] - count[gaps] + 1), 1 - 2 * count[gaps])
            gap = int(gaps[np.argmin(change)])
        if gap == capacity:
            bin_of[i] = made
            made += 1
        else:
            bin_of[i] = stacks[gap].pop()
            count[gap] -= 1
        offset[i] = capacity - gap
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(int(bin_of[i]))
    return bin_of, offset


def _pack(rows: pd.DataFrame, capacity: int, id_name: str) -> pd.DataFrame:
    bins, offset = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
    return rows.assign(**{id_name: rows["part"].to_numpy(np.int64) * (1 << 32) + bins, "offset": offset}).drop(columns="part")


def _grouped(rows: DataFrame, size: int) -> DataFrame:
    """Deals stored rows evenly to groups of at most about GROUP rows."""
    n = max(1, -(-size // GROUP))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("long"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long"
    pieces = stored(pick(docs, "doc_id", "text").mapInArrow(partial(_pieces, path=path, capacity=capacity), schema), "pack-pieces")
    first = _grouped(pieces, pieces.count()).groupBy("part").applyInPandas(partial(_pack, capacity=capacity, id_name="bin"), f"{schema}, bin long, offset long")
    placed = stored(first, "pack-bins")
    bins = placed.groupBy("bin").agg(F.sum("length").cast("long").alias("length"))
    least = bins.agg(F.min("length").alias("least"))
    open_bins = stored(bins.crossJoin(F.broadcast(least)).filter(F.col("length") + F.col("least") <= capacity).drop("least"), "pack-open")
    again = _grouped(open_bins, open_bins.count()).groupBy("part").applyInPandas(partial(_pack, capacity=capacity, id_name="joint"), "bin long, length long, joint long, offset long")
    moved = again.select("bin", "joint", F.col("offset").alias("base"))
    sequence = F.when(F.col("joint").isNull(), 2 * F.col("bin")).otherwise(2 * F.col("joint") + 1)
    return placed.join(moved, "bin", "left").select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )
