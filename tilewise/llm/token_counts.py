"""Token counts behind a digest cache.

A text's digest covers its normalised content and the tokenizer's version digest.
Digests are joined to a stored table of counts; each distinct missing digest is
encoded once and appended to that table, which later calls find by the same path.

Defined cases: null text counts as empty (0 tokens); repeated rows each get a row;
null ids are carried; extra columns are ignored; empty tables give empty results; a
very long text is encoded whole. Runs that fill a cache at the same time may both append
a digest; readers take one of the (equal) counts.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewise.llm.shared import pick, shared_dir, stored

#: Characters on which lower-casing, NFC and the letter classes agree everywhere.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")
#: Distinct words whose counts a Python worker remembers.
MEMO_WORDS = 400_000
#: Signs that are a part of their own after a letter at the end of a word.
STOPS = frozenset(".,;:!?")


def byte_letters() -> dict[str, str]:
    """The letter that byte-level tokenizers write for each byte: printable bytes stand for
    themselves, the others are numbered on from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(b): chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = str.maketrans(byte_letters())


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(a.content for a in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def version_digest(path: str) -> str:
    """Digest of the tokenizer file and of this module: counts of another file, or of another
    version of the counting code, are never shared."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + inspect.getsource(sys.modules[__name__]).encode()).hexdigest()


#: The normalizer and pre-tokenizer of tokenizers that may be counted by words.
BY_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BY_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def splits_at_space(path: str) -> bool:
    """Whether words parted by white space are encoded apart from each other.

    The tokenizer's own description says so; any other tokenizer encodes whole texts.
    """
    d = json.loads(tokenizer(path).to_str())
    steps = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [s.get("pattern", {}).get("Regex") for s in steps if s["type"] == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    bytewise = [s for s in steps if s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"]]
    return d["normalizer"] == BY_WORD_NORMALIZER and split == [BY_WORD_SPLIT] and len(steps) == 2 and len(bytewise) == 1


class _Memo(dict):
    """Token counts of the words met so far; a new word is encoded by the library."""

    def __init__(self, path: str):
        super().__init__()
        self.t = tokenizer(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        if word.isalpha():  # one part, for which the model alone is asked
            n = len(self.t.model.tokenize(word.encode().decode("latin-1").translate(LETTERS)))
        elif word[-1] in STOPS and word[:-1].isalpha():
            n = self[word[:-1]] + self[word[-1]]
        else:
            n = len(self.t.encode(word, add_special_tokens=False).ids)
        self[word] = n
        return n


@lru_cache(maxsize=4)
def _memo(path: str) -> _Memo:
    return _Memo(path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token counts as the library gives them.

    Where the tokenizer drops white space, a text of plain characters without special
    strings is the sum of its words, and each distinct word is encoded by the library
    once; any other text is encoded whole.
    """
    t, count, marks = tokenizer(path), _memo(path).__getitem__, specials(path)
    by_word = splits_at_space(path)
    return [
        sum(map(count, text.lower().split()))
        if by_word and not any(m in text for m in marks) and PLAIN.fullmatch(text)
        else len(t.encode(text, add_special_tokens=False).ids)
        for text in texts
    ]


def content_digest(text: str, path: str) -> bytes:
    """Digest of what the tokenizer sees: equal digests have equal counts.

    Texts that hold a special string are digested raw, since special strings are found
    before normalisation; others after it, so copies that differ in case or spacing meet.
    """
    if any(m in text for m in specials(path)):
        return hashlib.blake2b(b"raw\0" + text.encode(), digest_size=16).digest()
    if PLAIN.fullmatch(text) and splits_at_space(path):
        seen = " ".join(text.lower().split())
        return hashlib.blake2b(b"plain\0" + seen.encode(), digest_size=16).digest()
    return hashlib.blake2b(b"text\0" + text.encode(), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([content_digest(x, path) for x in texts], pa.binary()), pa.array([len(x.encode()) for x in texts], pa.int64())],
            ["doc_id", "digest", "n_bytes"],
        )


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or "" for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([content_digest(x, path) for x in texts], pa.binary()), b.column(0)], ["digest", "text"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_tokens(texts, path), pa.int64())], ["digest", "n_tokens"])


def _cached(spark, cache: str, version: str) -> DataFrame:
    schema = "digest binary, n_tokens long, version string"
    try:
        return spark.read.schema(schema).parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")


def fill_cache(docs: DataFrame, cache: str, path: str) -> None:
    """Encode each distinct digest that the cache lacks, once, and append the counts.

    One row per digest is kept before its text is sent on: copies within a map task
    collapse there, and a digest of very many copies never gathers in one task.
    """
    spark, version = docs.sparkSession, version_digest(path)
    known = _cached(spark, cache, version)
    texts = pick(docs, "text").mapInArrow(partial(_texts, path=path), "digest binary, text string")
    fresh = texts.join(known, "digest", "left_anti") if known.take(1) else texts
    misses = fresh.groupBy("digest").agg(F.first("text").alias("text"))
    counts = misses.mapInArrow(partial(_encode, path=path), "digest binary, n_tokens long")
    counts.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document.

    ``cache``: Parquet folder of counts, kept between calls; by default the folder of
    this tokenizer file in the shared folder, so a later call encodes new texts only.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    cache = cache or f"{shared_dir(spark)}/token-cache-{version_digest(path)}"
    fill_cache(docs, cache, path)
    digests = pick(docs, "doc_id", "text").mapInArrow(partial(_digests, path=path), "doc_id long, digest binary, n_bytes long")
    # stored, so that the join's two sides are plain shuffles and a frequent digest can be split
    counts = stored(_cached(spark, cache, version_digest(path)).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "token-counts")
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
