"""A quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns, taken over all documents,
estimates how often each labeller is right and how common good documents are; the
posterior of a document's pattern is its soft label. A linear scorer on hashed words and
hashed measure levels learns these labels and judges every document.

The label model sees all documents (at most 3 ** labellers patterns reach the driver).
The scorer is fitted on FIT_ROWS documents, those with the smallest hash of id and text.

Defined cases: null or blank texts get the patterns of an empty text and are judged
like others; repeated rows get equal scores; null ids are carried; extra columns are
kept by ``accepted`` and ignored by ``scores``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import textkernel as tk
from tilewise.llm.quality_rules import MEASURES, SYMBOLS, measure
from tilewise.llm.shared import pick

#: Documents on which the scorer is fitted, at most.
FIT_ROWS = 4000
#: Hashed feature space.
BITS = 14
#: Words of each document that the scorer's word features weigh together.
WORD_WEIGHT = 4.0
LABELLERS = ("repeats", "variety", "stutter", "lines", "symbols", "marked_words", "lone_signs", "few_stops", "prose")


def _facts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(facts per text, word text index, word hash): mostly shares of the words."""
    n = len(offsets) - 1
    m = dict(zip(MEASURES, measure(data, offsets), strict=True))
    start, end, of, h = tk.word_hashes(data, offsets, tk.SPACE_DELIMS, True)
    words = np.maximum(m["n_words"], 1)
    seen = np.unique(tk.splitmix(h + of.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)), return_index=True)[1]
    sign = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    signs = np.concatenate([[0], np.cumsum(sign)])

    def share(is_so: np.ndarray) -> np.ndarray:
        return np.bincount(of[is_so], minlength=n) / words

    stutter = np.zeros(len(of), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    facts = np.stack(
        [
            m["n_repeat_words"] / words,
            np.bincount(of[seen], minlength=n) / np.sqrt(2.0 * words),
            share(stutter),
            m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
            m["n_symbols"] / words,
            share(signs[end] - signs[start] > 0),
            share((end - start == 1) & sign[start]) if len(start) else np.zeros(n),
            share(np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8))) if len(end) else np.zeros(n),
            np.log2(words),
        ],
        axis=1,
    )
    return facts, of, h


def votes(facts: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 no opinion: one column per labeller.

    Fault finders only ever vote bad; the last labeller also knows what prose is like.
    """
    rep, variety, stutter, dup, sym, marked, lone, stops, size = facts.T
    fault = lambda is_so: np.where(is_so, -1, 0)
    long = size >= 5
    return np.stack(
        [
            fault(long & (rep > 0.6)),
            fault(long & (variety < 1.3)),
            fault(long & (stutter > 0.1)),
            fault(dup > 0.4),
            fault(sym > 0.1),
            fault(marked > 0.1),
            fault(lone > 0.1),
            fault(long & (stops < 0.02)),
            np.where((rep < 0.1) & (sym < 0.02) & (dup < 0.2) & (stops > 0.03) & (stops < 0.5), 1, fault((rep > 0.8) | (sym > 0.5))),
        ],
        axis=1,
    ).astype(np.int8)


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _unpattern(p: np.ndarray) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.texts_of(b.column(1))
        got = [_pattern(votes(_facts(d, o)[0])) for _, _, d, o in tk.runs(data, offsets)]
        at = np.concatenate(got) if got else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at)], ["pattern"])


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> dict[int, float]:
    """Posterior of good for each vote pattern, by expectation-maximisation.

    Each labeller has its own rates of the three votes given good and given bad; it
    starts as one that is right in most cases, which fixes which class is which.
    """
    v = _unpattern(patterns) + 1
    w = counts.astype(float)
    rate = np.tile(np.array([[0.5, 0.45, 0.05], [0.01, 0.69, 0.3]])[None], (len(LABELLERS), 1, 1))
    prior = np.array([0.2, 0.8])
    post = np.zeros((len(v), 2))
    for _ in range(rounds):
        logs = np.log(prior) + sum(np.log(rate[k][:, v[:, k]]).T for k in range(len(LABELLERS)))
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * w[:, None]
        prior = (mass.sum(axis=0) + 1) / (mass.sum() + 2)
        for k in range(len(LABELLERS)):
            for x in range(3):
                rate[k][:, x] = mass[v[:, k] == x].sum(axis=0) + 1
            rate[k] /= rate[k].sum(axis=1, keepdims=True)
    return dict(zip(patterns.tolist(), post[:, 1].tolist(), strict=True))


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight, pattern): words hashed to BITS, and levels of the facts."""
    facts, of, h = _facts(data, offsets)
    n = len(offsets) - 1
    size = np.bincount(of, minlength=n)
    text = [of]
    where = [(h >> tk.U(64 - BITS)).astype(np.int64)]
    weight = [WORD_WEIGHT / np.maximum(size, 1)[of]]
    level = np.clip(np.floor(facts * np.array([20, 4, 20, 10, 20, 20, 20, 20, 1])), 0, 40).astype(np.int64)
    for k in range(facts.shape[1]):
        key = tk.splitmix((level[:, k] + 1000 * (k + 1)).astype(tk.U))
        text.append(np.arange(n))
        where.append((key >> tk.U(64 - BITS)).astype(np.int64))
        weight.append(np.ones(n))
    return np.concatenate(text), np.concatenate(where), np.concatenate(weight), _pattern(votes(facts))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.texts_of(b.column(1))
        out = []
        for i, j, d, o in tk.runs(data, offsets):
            text, where, weight, pattern = _features(d, o)
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(j - i + 1))
            for k in range(j - i):
                at = order[cut[k] : cut[k + 1]]
                f, inv = np.unique(where[at], return_inverse=True)
                out.append((int(pattern[k]), f.astype("<i4").tobytes(), np.bincount(inv, weight[at]).astype("<f4").tobytes()))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), b.column(3)], ["key", "pattern", "f", "w", "n"])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps, in the given order."""
    w, g, bias, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        for f, x, y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[f] @ x + bias, -30, 30)))
            d = (p - y) * x + decay * w[f]
            g[f] += d * d
            w[f] -= rate * d / np.sqrt(g[f])
            gb += (p - y) ** 2
            bias -= rate * (p - y) / np.sqrt(gb)
    return w, bias


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """The scorer for these documents."""
    texts = pick(docs, "doc_id", "text")
    found = texts.select("doc_id", "text").mapInArrow(_voted, "pattern long").groupBy("pattern").count().collect()
    if not found:
        return np.zeros(1 << BITS), 0.0
    soft = label_model(np.array([r[0] for r in found]), np.array([r[1] for r in found]))
    # the FIT_ROWS smallest hashes are found on the hashes alone; no text is sorted
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    last = keyed.select("key").orderBy("key").limit(FIT_ROWS).agg(F.max("key")).first()[0]
    # equal rows come once, with their number: however many there are, few rows reach the driver
    each = keyed.filter(F.col("key") <= last).groupBy("doc_id", "text", "key").agg(F.count("*").alias("n"))
    chosen = each.mapInArrow(_fit_rows, "key long, pattern long, f binary, w binary, n long").collect()
    rows = []
    for _, pattern, f, w, n in sorted(chosen):
        rows += [(np.frombuffer(f, "<i4"), np.frombuffer(w, "<f4").astype(float), soft[pattern])] * min(n, FIT_ROWS - len(rows))
    return fit(rows)


def _scored(batches: Iterator[pa.RecordBatch], w: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.texts_of(b.column(1))
        out = []
        for i, j, d, o in tk.runs(data, offsets):
            text, where, weight, _ = _features(d, o)
            out.append(np.bincount(text, w[where] * weight, minlength=j - i))
        z = np.concatenate(out) + bias if out else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], ["row", "score"])


def _scored_docs(batches: Iterator[pa.RecordBatch], w: np.ndarray, bias: float, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        scored = next(_scored(iter([pa.RecordBatch.from_arrays([b.column(at), b.column(at)], ["row", "text"])]), w, bias))
        yield b.filter(pa.array(np.asarray(scored.column(1)) >= least))


def scores(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, score, kept`` of each document."""
    w, bias = train(docs)
    scored = pick(docs, "doc_id", "text").mapInArrow(partial(_scored, w=w, bias=bias), "row long, score double")
    return scored.select(F.col("row").alias("doc_id"), "score", (F.col("score") >= least).alias("kept"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    w, bias = train(docs)
    return docs.mapInArrow(partial(_scored_docs, w=w, bias=bias, least=least), docs.schema)
