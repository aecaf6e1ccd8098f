"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document; the ledger stores the measurements and
one bit per failed rule. A policy is a version name and a mask over those bits, so
new policies and ablations are bitwise work on the stored ledger, not a new scan.

Defined cases: null or blank texts have no words and zero measures (they fail
``few_words``); repeated rows each get their own ledger row; null ids are carried;
extra columns of the input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise.llm import textkernel as tk
from tilewise.llm.shared import pick

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in bit order: name, and the condition under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules whose failure removes a document.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["many_symbols"] | BIT["duplicate_lines"],
    "v2": BASE | BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
}


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One column of MEASURES for each text of a run."""
    n = len(offsets) - 1
    out = np.zeros((len(MEASURES), n), np.int64)
    if not len(data):
        return out
    inside = ~tk.SPACE_DELIMS[data]
    start, end = tk.spans(inside, offsets)
    text = tk.owner(start, offsets)
    prefix = tk.prefix_hash(data)
    out[0] = np.bincount(text, minlength=n)
    out[1] = tk.per_text(inside & ((data & 0xC0) != 0x80), offsets)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out[2] = tk.per_text(symbol[data], offsets)
    first, last = tk.spans(data != 10, offsets)
    worded = np.concatenate([[0], np.cumsum(inside)])
    keep = worded[last] > worded[first]
    first, last = first[keep], last[keep]
    of = tk.owner(first, offsets)
    out[3] = np.bincount(of, minlength=n)
    line = tk.splitmix(tk.span_hash(prefix, first, last) + of.astype(tk.U) * tk._STEP[61])
    _, at = np.unique(line, return_index=True)
    out[4] = out[3] - np.bincount(of[at], minlength=n)
    at, key = tk.windows(tk.span_hash(prefix, start, end), text, WINDOW)
    if len(at):
        key = tk.splitmix(key + text[at].astype(tk.U) * tk._STEP[61])
        _, same, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[same] > 1]
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        out[5] = np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.texts_of(b.column(1))
        parts = [measure(d, o) for _, _, d, o in tk.runs(data, offsets)]
        got = np.concatenate(parts, axis=1) if parts else np.zeros((len(MEASURES), 0), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, got)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of each document; no shuffle."""
    measured = pick(docs, "doc_id", "text").mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits: Column = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds ``kept`` under the policy of that version; the ledger is not rebuilt."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: how many it fails, and how many only it removes.

    The ledger is first folded to its distinct masked bit patterns (at most
    2 ** rules rows), so the per-rule work doesn't touch documents again.
    """
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask]
    return (
        patterns.select("n", "bits", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )
