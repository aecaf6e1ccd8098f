"""Ranked lexical search over hashed max-sketches.

A document's impacts (what each of its terms could add to a score) are folded into one
byte per hashed coordinate: the largest impact that lands there, rounded up. Each impact is
folded into ROWS rows of coordinates by hashes of their own. Queries are looked up in
batches: a term adds no more than the least of its coordinates, and the sum over a query's
terms bounds its score from above. Only documents whose bound reaches the threshold are
scored from their texts, in descending order of bounds, so the ten best are exact however
loose a bound is.

``build`` writes the statistics and the sketches, ``search`` reads them:

1. statistics: terms and their document frequencies, the documents with terms, all terms;
2. sketches: a width of at least WIDTH coordinates per distinct term, so the bounds of
   long texts are as tight as those of short ones;
3. bounds from the sketches alone give the first rows of each query (FIRST times k); the
   k-th of their exact scores is the query's threshold;
4. every row whose bound reaches the threshold is scored, highest bound first, until the
   bounds fall below the best k that its task has met (or the threshold).

Impacts use exact weights for the most frequent terms (at most FREQUENT, whatever the
corpus) and the largest possible weight for others: common words, which share coordinates
with most query terms, thus add little to a bound. Queries are taken in batches of bounded
size; nothing but a batch, its terms and its first rows is sent to the tasks.

Defined cases: null texts, and texts without a term, have no score and count in no
statistic; a query without terms has no rows; rows that repeat an id, of documents or
queries, are rows of their own; of equal scores the smaller id comes first, null ids last;
very long texts are read in pieces; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.llm.shared import pick, stored

K = 10
#: Rows scored first, for each of the k wanted.
FIRST = 4
#: Rows of a sketch, and coordinates of a row for each distinct term of a document, at least:
#: a term that a document lacks meets others in all rows in one of 72 cases or fewer.
ROWS, WIDTH = 2, 8
LEAST_WIDTH = 64
#: Terms with exact weights in the sketches, at most.
FREQUENT = 16_384
#: Queries and query terms of one batch (a single query may have more terms).
BATCH_QUERIES, BATCH_TERMS = 256, 32_768
#: Terms that a task holds before it passes their counts on, or remembers.
HELD_TERMS = 250_000
#: Bytes of a text taken at a time, and bounds of a block.
PIECE, BLOCK = 1 << 20, 1 << 22
#: Most coordinates are 0, so sketches are stored packed.
CODEC = "zstd"

#: Term bytes to themselves (A-Z lower-cased), all others to a space: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    data = (text or "").encode().translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        if words := data[at:end].split():
            yield words
        at = end


def counted(text: str | None) -> Counter:
    found: Counter = Counter()
    for words in terms_of(text):
        found.update(words)
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + (75 * n * n_docs) // n_terms


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def unit(n_docs: int) -> int:
    """What one step of a coordinate stands for: the largest impact has at most 250 of them."""
    return weight(n_docs, 1) * 1_000_000 // 250 + 1


def slots(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The coordinate of each hash in each row; the rows stand one behind the other."""
    high = np.uint64(65 - int(width).bit_length())
    return [((hashes * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1E * r & (1 << 64) - 1))) >> high).astype(np.int64) + r * width for r in range(ROWS)]


# --- building


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies as far as a task has come; a null term has documents and all terms."""
    held: Counter = Counter()
    n_docs = n_terms = 0

    def passed() -> pa.RecordBatch:
        kinds = [pa.array([None, *held], pa.binary()), pa.array([n_docs, *held.values()], pa.int64()), pa.array([n_terms] + [0] * len(held), pa.int64())]
        return pa.RecordBatch.from_arrays(kinds, ["term", "df", "n_terms"])

    for b in batches:
        for text in b.column(0):
            own, n = set(), 0
            for words in terms_of(text.as_py()):
                own.update(words)
                n += len(words)
            held.update(own)
            n_docs, n_terms = n_docs + bool(n), n_terms + n
            if len(held) >= HELD_TERMS:
                yield passed()
                held.clear()
                n_docs = n_terms = 0
    yield passed()


class Weights(dict):
    """Hash (lower 32 bits) and upper bound of the weight of each term met; common terms have exact weights."""

    def __init__(self, frequent: dict[bytes, int], n_docs: int):
        super().__init__()
        self.frequent, self.n_docs, self.most = frequent, n_docs, weight(n_docs, 1)

    def __missing__(self, term: bytes) -> int:
        if len(self) >= HELD_TERMS:
            self.clear()
        df = self.frequent.get(term)
        self[term] = got = (self.most if df is None else weight(self.n_docs, df)) << 32 | zlib.crc32(term)
        return got


def sketch(found: Counter, weights: Weights, n_docs: int, n_terms: int) -> bytes:
    """The coordinatewise maxima of a document's impacts, in units, rounded up."""
    width = max(LEAST_WIDTH, 1 << (WIDTH * len(found) - 1).bit_length())
    of = np.fromiter(map(weights.__getitem__, found), np.int64, len(found))
    tf = np.fromiter(found.values(), np.int64, len(found))
    m = length_factor(int(tf.sum()), n_docs, n_terms)
    steps = -(-((of >> 32) * (1_000_000_000 * tf // (1000 * tf + 8 * m))) // unit(n_docs))
    order = np.argsort(steps, kind="stable")
    out, steps = np.zeros(ROWS * width, np.uint8), steps[order].astype(np.uint8)
    for row in slots((of[order] & 0xFFFFFFFF).astype(np.uint64), width):
        out[row] = steps  # the last one written is the largest
    return out.tobytes()


def _sketched(batches: Iterator[pa.RecordBatch], frequent: dict[bytes, int], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    weights, row = Weights(frequent, n_docs), TaskContext.get().partitionId() << 40
    for b in batches:
        kept, widths, sketches = [], [], []
        for k, text in enumerate(b.column(1)):
            if found := counted(text.as_py()):
                kept.append(k)
                made = sketch(found, weights, n_docs, n_terms)
                widths.append(len(made) // ROWS)
                sketches.append(pa.compress(made, CODEC, asbytes=True))
        some = b.take(pa.array(kept, pa.int64()))
        rows = pa.array(np.arange(row, row + len(kept), dtype=np.int64))
        row += len(kept)
        yield pa.RecordBatch.from_arrays([rows, some.column(0), pa.array(widths, pa.int32()), pa.array(sketches, pa.binary()), some.column(1)], ["row", "doc_id", "width", "sketch", "text"])


class Index:
    """Statistics and sketches of a corpus, as tables in the shared folder."""

    def __init__(self, terms: DataFrame, rows: DataFrame | None, n_docs: int, n_terms: int):
        self.terms, self.rows, self.n_docs, self.n_terms = terms, rows, n_docs, n_terms


def build(docs: DataFrame) -> Index:
    """An index of ``doc_id, text``; no shuffle but that of term counts."""
    counts = pick(docs, "text").mapInArrow(_statistics, "term binary, df long, n_terms long")
    terms = stored(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_terms").alias("n_terms")), "search-terms")
    total = terms.filter("term IS NULL").first()
    n_docs, n_terms = (total.df, total.n_terms) if total else (0, 0)
    terms = terms.filter("term IS NOT NULL").select("term", "df")
    if not n_docs:
        return Index(terms, None, 0, 0)
    # the lowest level of document frequencies whose terms, with those above, are at most FREQUENT
    level = F.floor(F.log2("df")).cast("int")
    least, so_far = None, 0
    for r in sorted(terms.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if (so_far := so_far + r["count"]) > FREQUENT:
            break
        least = r["level"]
    frequent = {} if least is None else {bytes(r.term): r.df for r in terms.filter(level >= least).collect()}
    kernel = partial(_sketched, frequent=frequent, n_docs=n_docs, n_terms=n_terms)
    rows = stored(pick(docs, "doc_id", "text").mapInArrow(kernel, "row long, doc_id long, width int, sketch binary, text string"), "search-sketches")
    return Index(terms, rows, n_docs, n_terms)


# --- searching


class Batch:
    """Queries of a batch: their terms with repeats, weights and caps in units."""

    def __init__(self, queries: list[Counter], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms, self.unit = n_docs, n_terms, unit(n_docs)
        self.terms = sorted({t for q in queries for t in q if t in df})
        self.weights = {t: weight(n_docs, df[t]) for t in self.terms}
        self.hashes = np.array([zlib.crc32(t) for t in self.terms], np.uint64)
        self.caps = np.array([min(255, -(-self.weights[t] * 1_000_000 // self.unit)) for t in self.terms], np.uint8)
        self.queries = [{t: n for t, n in q.items() if t in df} for q in queries]
        most = max((255 * sum(q.values()) for q in self.queries), default=0)
        at = {t: i for i, t in enumerate(self.terms)}
        self.repeats = np.zeros((len(self.terms), len(queries)), np.float32 if most < 1 << 24 else np.float64)  # sums are whole numbers, held exactly
        for j, q in enumerate(self.queries):
            for t, n in q.items():
                self.repeats[at[t], j] = n

    def bounds(self, widths: pa.Array, sketches: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, bounds in units of each query) for blocks of sketches of one width."""
        width = widths.to_numpy(zero_copy_only=False)
        for w in np.unique(width).tolist():
            at, some, rows = np.nonzero(width == w)[0], max(1, BLOCK // max(1, len(self.terms), ROWS * w)), slots(self.hashes, w)
            for k in range(0, len(at), some):
                block = at[k : k + some]
                held = np.stack([np.frombuffer(pa.decompress(sketches[int(i)].as_buffer(), ROWS * w, CODEC), np.uint8) for i in block])
                least = np.minimum(held[:, rows[0]], self.caps)
                for row in rows[1:]:
                    np.minimum(least, held[:, row], out=least)
                yield block, least.astype(self.repeats.dtype) @ self.repeats

    def scores(self, found: Counter) -> dict[bytes, int]:
        """What each query term adds for one document."""
        m = length_factor(sum(found.values()), self.n_docs, self.n_terms)
        return {t: self.weights[t] * impact(found[t], m) for t in self.weights.keys() & found.keys()}

    def score(self, j: int, adds: dict[bytes, int]) -> int:
        return sum(n * adds[t] for t, n in self.queries[j].items() if t in adds)


def _best_bounds(batches: Iterator[pa.RecordBatch], batch: Batch, k: int) -> Iterator[pa.RecordBatch]:
    """The k rows of highest bounds that a task has for each query."""
    best: list[list[tuple[int, int]]] = [[] for _ in batch.queries]
    for b in batches:
        rows = b.column(0).to_numpy()
        for at, bounds in batch.bounds(b.column(1), b.column(2)):
            for j, heap in enumerate(best):
                own = bounds[:, j]
                least = heap[0][0] if len(heap) == k else 0
                for i in np.nonzero(own > least)[0][np.argsort(-own[own > least], kind="stable")][:k]:
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (int(own[i]), int(rows[at[i]])))
    got = [(j, bound, row) for j, heap in enumerate(best) for bound, row in heap]
    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "bound", "row"])


def _first_scores(batches: Iterator[pa.RecordBatch], batch: Batch) -> Iterator[pa.RecordBatch]:
    """Exact scores of rows for the queries that name them."""
    for b in batches:
        got = []
        for text, queries in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            adds = batch.scores(counted(text.as_py()))
            got += [(j, batch.score(j, adds)) for j in queries]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64())], ["query", "score"])


def _order(score: int, doc_id: int | None) -> tuple:
    """Rises with the rank: higher scores, then smaller ids, null ids last."""
    return score, doc_id is not None, -(doc_id or 0)


def _rescored(batches: Iterator[pa.RecordBatch], batch: Batch, thresholds: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows that a task has for each query, of those that reach its threshold."""
    best: list[list[tuple]] = [[] for _ in batch.queries]
    needed = np.array([-(-t // batch.unit) for t in thresholds])
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(3)
        wanted: list[tuple[int, int, int]] = []
        for at, bounds in batch.bounds(b.column(1), b.column(2)):
            i, j = np.nonzero(bounds >= needed)
            wanted += zip((-bounds[i, j]).astype(np.int64).tolist(), at[i].tolist(), j.tolist(), strict=True)
        adds: dict[int, dict[bytes, int]] = {}
        for bound, i, j in sorted(wanted):
            heap = best[j]
            if -bound * batch.unit < max(thresholds[j], heap[0][0][0] if len(heap) == k else 0):
                continue
            if i not in adds:
                adds[i] = batch.scores(counted(texts[i].as_py()))
            if (score := batch.score(j, adds[i])) >= thresholds[j]:
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (_order(score, ids[i]), ids[i] is None, ids[i] or 0))
    got = [(j, order[0], None if null else doc) for j, heap in enumerate(best) for order, null, doc in heap]
    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "score", "doc_id"])


def search_batch(spark: SparkSession, index: Index, items: list[tuple[int | None, Counter]], k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the queries of one batch."""
    # the terms of a batch have a bounded number, and each is one row of the statistics
    asked = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, q in items for t in q})], "term binary")
    df = {bytes(r.term): r.df for r in index.terms.join(F.broadcast(asked), "term").collect()}
    batch = Batch([q for _, q in items], df, index.n_docs, index.n_terms)
    by_query = W.partitionBy("query")
    bounds = index.rows.select("row", "width", "sketch").mapInArrow(partial(_best_bounds, batch=batch, k=FIRST * k), "query int, bound long, row long")
    first = bounds.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("bound"), "row"))).filter(F.col("place") <= FIRST * k)
    # at most FIRST * k rows for each query of a batch
    named = stored(first.groupBy("row").agg(F.collect_list("query").alias("queries")), "search-first")
    exact = index.rows.join(F.broadcast(named), "row").select("text", "queries").mapInArrow(partial(_first_scores, batch=batch), "query int, score long")
    reached = {r["query"]: sorted(r.scores) for r in exact.groupBy("query").agg(F.collect_list("score").alias("scores")).collect()}
    thresholds = [max(1, reached[j][-k]) if len(reached.get(j, ())) >= k else 1 for j in range(len(items))]
    scored = index.rows.select("doc_id", "width", "sketch", "text").mapInArrow(partial(_rescored, batch=batch, thresholds=thresholds, k=k), "query int, score long, doc_id long")
    ranked = scored.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(items)], "query int, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def batches_of(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The queries in batches; the driver holds one at a time."""
    held: list[tuple[int | None, Counter]] = []
    n = 0
    for r in pick(items, "item_id", "text").toLocalIterator():
        if q := counted(r.text):
            if held and (len(held) == BATCH_QUERIES or n + len(q) > BATCH_TERMS):
                yield held
                held, n = [], 0
            held.append((r.item_id, q))
            n += len(q)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of each item, as ``item_id, rank, doc_id, score``."""
    spark, index = docs.sparkSession, build(docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if index.rows is not None:
        for held in batches_of(items):
            out = out.unionByName(stored(search_batch(spark, index, held, k), "search-ranks"))
    return out
