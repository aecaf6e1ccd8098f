"""URL filters by a Bloom filter cascade.

A rule lists a host, with all its subdomains, and a beginning of the path. A URL's keys are
its host and the parents of it, each with the beginnings of its path whose lengths occur in
rules; a rule fits if it is one of them, so judging a URL is asking which of its keys are
listed. A cascade answers that exactly, without a join: the first filter holds the listed
keys, the second those keys of the corpus that the first one takes for listed, the third the
listed ones that the second takes for such, and so on until a level takes nothing wrongly.
The answer is exact for every key of the universe from which the cascade was built, which
are all keys of the corpus, and all listed ones.

Each kind of rule (block, allow) has a cascade of its own. Of the listed keys of a URL the
longest wins; a key listed in both kinds is blocked. URLs that no rule fits get the default
verdict. A cascade is sent to all tasks, so none of its filters may have more than
MOST_BITS; with a longer list the keys are joined instead, with the same result.

Defined cases: null URLs and those without ``://`` have an empty host and path, which no
rule fits unless it lists the empty host; hosts are taken as they stand (port and user are
part of them); repeated rows are judged each; very long URLs have no more keys than
rules can reach, as no key is longer than the longest rule; extra columns are ignored;
empty tables, of pages or rules, give no rows or the default.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.llm.shared import pick, stored

#: Hash functions of a level, and bits for each of its keys and functions.
HASHES, BITS = 7, 1.45
#: Of the first level: enough that it takes about as many keys wrongly as it holds.
FIRST_HASHES = (4, 30)
#: Bits of a filter, at most (8 MB).
MOST_BITS = 1 << 26
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
KEYS = "host string, path string"

Keys = list[tuple[str, str]]


class Reach:
    """What the rules can reach: the lengths of their paths, and the longest host."""

    def __init__(self, lengths: list[int], longest: int):
        self.lengths, self.longest = sorted(lengths, reverse=True), longest

    def hosts(self, host: str) -> list[str]:
        """The host and its parents, as far as a rule can list them."""
        least = max(0, len(host) - self.longest)
        found, at = [] if least else [host], host.find(".", max(0, least - 1))
        while at >= 0:
            found.append(host[at + 1 :])
            at = host.find(".", at + 1)
        return found

    def keys(self, host: str, path: str) -> Keys:
        """The keys of a URL that may be listed, longest first; of equal length, the longer host."""
        found = [(h, path[:n]) for h in self.hosts(host) for n in self.lengths if n <= len(path)]
        return sorted(found, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))


def bits_of(key: tuple[str, str], level: int, size: int, hashes: int) -> list[int]:
    digest = hashlib.blake2b(f"{level}\n{key[0]}\n{key[1]}".encode(), digest_size=16).digest()
    a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return [(a + i * b) % size for i in range(hashes)]


class Cascade:
    """Filters of alternating meaning; ``key in cascade`` is exact within its universe."""

    def __init__(self):
        self.levels: list[tuple[bytes, int]] = []

    def passes(self, key: tuple[str, str], level: int) -> bool:
        held, hashes = self.levels[level]
        return all(held[bit >> 3] >> (bit & 7) & 1 for bit in bits_of(key, level, len(held) * 8, hashes))

    def __contains__(self, key: tuple[str, str]) -> bool:
        for level in range(len(self.levels)):
            if not self.passes(key, level):
                return level % 2 == 1
        return len(self.levels) % 2 == 1


def _set_bits(batches: Iterator[pa.RecordBatch], level: int, size: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """Words of the filter with the bits of a task's keys."""
    held = bytearray(size // 8)
    for b in batches:
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for bit in bits_of(key, level, size, hashes):
                held[bit >> 3] |= 1 << (bit & 7)
    words = np.frombuffer(held, "<u4").astype(np.int64)
    at = np.nonzero(words)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["word", "bits"])


def filter_of(keys: DataFrame, level: int, size: int, hashes: int) -> tuple[bytes, int]:
    """The level's filter; the driver gets its words, whose number is bounded."""
    words = keys.mapInArrow(partial(_set_bits, level=level, size=size, hashes=hashes), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 32, "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out.tobytes(), hashes


def _passing(batches: Iterator[pa.RecordBatch], cascade: Cascade, level: int) -> Iterator[pa.RecordBatch]:
    """Keys that one level holds or takes wrongly."""
    for b in batches:
        keep = [cascade.passes(key, level) for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield b.filter(pa.array(keep, pa.bool_()))


def _universe(batches: Iterator[pa.RecordBatch], reach: Reach, cascade: Cascade) -> Iterator[pa.RecordBatch]:
    """The keys of URLs that pass the first level, each once for a batch."""
    for b in batches:
        addresses = set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        met = sorted(k for k in {k for a in addresses for k in reach.keys(*a)} if cascade.passes(k, 0))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in met], pa.string()), pa.array([k[1] for k in met], pa.string())], ["host", "path"])


def cascade_of(listed: DataFrame, addresses: DataFrame, reach: Reach, most_bits: int = MOST_BITS) -> Cascade | None:
    """A cascade of the distinct ``host, path`` listed, exact for all keys of the addresses.

    None if a filter would have more than ``most_bits``.
    """
    cascade, n = Cascade(), listed.count()
    if not n:
        return cascade
    asked = 4 * len(reach.lengths) * addresses.count()
    hashes = min(max(FIRST_HASHES[0], math.ceil(math.log2(asked / n + 1))), FIRST_HASHES[1])
    if (size := _size(n, hashes)) > most_bits:
        return None
    cascade.levels.append(filter_of(listed, 0, size, hashes))
    met = addresses.mapInArrow(partial(_universe, reach=reach, cascade=cascade), KEYS).distinct()
    # level by level: what it must hold, and what it must not
    inside, outside = listed, stored(met.join(listed, ["host", "path"], "left_anti"), "url-wrong")
    while n := outside.count():
        if (size := _size(n, HASHES)) > most_bits:
            return None
        level = len(cascade.levels)
        cascade.levels.append(filter_of(outside, level, size, HASHES))
        wrong = stored(inside.mapInArrow(partial(_passing, cascade=cascade, level=level), KEYS), "url-wrong")
        inside, outside = outside, wrong
    return cascade


def _size(n: int, hashes: int) -> int:
    """Bits of a filter of n keys, in whole words."""
    return 64 * max(1, math.ceil(n * hashes * BITS / 64))


def addresses_of(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of each page."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pick(pages, "page_id", "url").select("page_id", host.alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def _judged(batches: Iterator[pa.RecordBatch], reach: Reach, block: Cascade, allow: Cascade, default: str) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=100_000)
    def kind(key: tuple[str, str]) -> str | None:
        return "block" if key in block else "allow" if key in allow else None

    for b in batches:
        rules, verdicts = [], []
        for address in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            key, verdict = next(((k, v) for k in reach.keys(*address) if (v := kind(k))), (None, default))
            rules.append(key and "".join(key))
            verdicts.append(verdict)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])


def _keyed(batches: Iterator[pa.RecordBatch], reach: Reach) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(a, *k, place) for a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for place, k in enumerate(reach.keys(*a))]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        flat = [(a[0], a[1], host, path, place) for a, host, path, place in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], ["host", "path", "rule_host", "rule_path", "place"])


def joined(addresses: DataFrame, rules: DataFrame, reach: Reach, default: str) -> DataFrame:
    """The same verdicts by a join on keys, for lists too long for a cascade."""
    keys = addresses.select("host", "path").distinct().mapInArrow(partial(_keyed, reach=reach), "host string, path string, rule_host string, rule_path string, place int")
    own = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    best = keys.join(own, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.min(F.struct("place", "rule_host", "rule_path", "verdict")).alias("m"))
    found = best.select("host", "path", F.concat("m.rule_host", "m.rule_path").alias("rule"), F.col("m.verdict").alias("own"))
    return addresses.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page; rules: ``host, path, verdict``."""
    addresses = addresses_of(pages)
    # 'block' stands behind 'allow', so it is the largest
    rules = stored(pick(rules, "host", "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    reach = Reach(lengths, rules.agg(F.max(F.length("host"))).first()[0] or 0)
    block, allow = (cascade_of(rules.filter(F.col("verdict") == v).select("host", "path"), addresses.select("host", "path"), reach, most_bits) for v in ("block", "allow"))
    if block is None or allow is None:
        return joined(addresses, rules, reach, default)
    kernel = partial(_judged, reach=reach, block=block, allow=allow, default=default)
    return addresses.mapInArrow(kernel, "page_id long, host string, path string, rule string, verdict string")


#: The rules that the contract names, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(host, path, verdict) for verdict, host, path in RULES], "host string, path string, verdict string")
