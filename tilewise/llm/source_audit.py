"""Source divergence audit by token-start pointers.

Within a task, the texts of an Arrow batch are one buffer, and a term is a pointer to the
byte at which it starts. Pointers are cut into slices and each slice is put in order by a
multikey quicksort, eight bytes to a key: pointers with the pivot's key go on to the next
eight bytes only where their terms do. Pointers to equal terms then stand in runs, and a run
gives the term's occurrences and documents by language and source. Spark adds up the runs of
all tasks; from there on the rows are terms, not texts.

Each language keeps the terms of at least ``least_docs`` of its documents. Sources are
compared by smoothed shares of the kept terms, in parts per 10**9, in whole numbers: pairs of
sources by the sum of differences over all kept terms, terms by how far a source's share
exceeds its language's.

The pair sums are taken in blocks of terms and tiles of sources, each block a matrix that
stays in its task; terms that neither source has add the same amount each, so they are
counted, not listed.

Defined cases: null text, lang and source are ''; a group without kept terms still has rows
for its pairs; a language without kept terms has value 0 for all pairs; repeated rows count
as documents of their own; of equal values the smaller name in UTF-8 comes first; very long
texts are slices of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.llm import textkernel as tk
from tilewise.llm.shared import pick, stored

LEAST_DOCS = 30
TOP_TERMS = 50
#: Added to each count, and what a share of 1 is.
PRIOR, WHOLE = 5, 1_000_000_000
#: Bytes of the texts of one slice (a longer text is its own).
SLICE_BYTES = 1 << 22
#: Slices of so many pointers are sorted at once if their terms have so many bytes left.
SMALL, SHORT = 1 << 12, 64
#: Sources of a tile, and terms of a block, about.
TILE, BLOCK_TERMS = 128, 4096

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`
TERM_DELIMS = np.zeros(256, bool)
TERM_DELIMS[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
COUNTS = "lang string, source string, term string, n long, docs long"


def keys_at(data: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each term as a number; beyond its end there are zeros."""
    words = np.ndarray(len(data) - 7, ">u8", np.ascontiguousarray(data), strides=1)  # one at every byte
    key = words[start].astype(np.uint64)
    short = left < 8
    key[short] &= ~np.uint64(0) << (8 * (8 - np.maximum(left[short], 0))).astype(np.uint64)
    return key


def sort_pointers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, and where each run of equal terms begins."""
    out, begins, done = [], [], 0
    # slices still to be sorted, the last one first; a slice is equal up to its depth
    todo = [(np.arange(len(start)), 0, False)] if len(start) else []
    while todo:
        at, depth, ended = todo.pop()
        if not len(at):
            continue
        left = int(length[at].max()) - depth
        if ended or len(at) == 1:
            out.append(at)
            begins.append(np.array([done]))
            done += len(at)
        elif len(at) <= SMALL and left <= SHORT:
            keys = [keys_at(data, start[at] + d, length[at] - d) for d in range(depth, depth + left, 8)]
            order = np.lexsort(keys[::-1])
            differs = np.any([(k := key[order])[1:] != k[:-1] for key in keys], axis=0)
            out.append(at[order])
            begins.append(np.concatenate([[0], np.nonzero(differs)[0] + 1]) + done)
            done += len(at)
        else:
            key = keys_at(data, start[at] + depth, length[at] - depth)
            some = np.sort(key[:: max(1, len(key) // 31)])
            less, more = key < some[len(some) // 2], key > some[len(some) // 2]
            equal = at[~(less | more)]
            goes_on = int(length[equal].max()) > depth + 8
            todo += [(at[more], depth, False), (equal, depth + 8, not goes_on), (at[less], depth, False)]
    none = np.zeros(0, np.int64)
    return np.concatenate(out) if out else none, np.concatenate(begins) if begins else none


def runs_of(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[list[bytes], np.ndarray]:
    """Terms of a slice, and rows (term, group, occurrences, documents)."""
    data = tk.LOWER[data]
    start, end = tk.spans(~TERM_DELIMS[data], offsets)
    padded = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])  # room for keys beyond the last term
    order, begins = sort_pointers(padded, start, end - start)
    if not len(order):
        return [], np.zeros((4, 0), np.int64)
    n_docs = len(offsets) - 1
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    met, times = np.unique(run * n_docs + tk.owner(start[order], offsets), return_counts=True)
    cell = met // n_docs * n_groups + group[met % n_docs]
    cells, of = np.unique(cell, return_inverse=True)
    n, docs = np.bincount(of, times, len(cells)).astype(np.int64), np.bincount(of, minlength=len(cells))
    heads = order[begins]
    return [data[s:e].tobytes() for s, e in zip(start[heads], end[heads], strict=True)], np.stack([cells // n_groups, cells % n_groups, n, docs])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"])
        pairs = [(r["lang"], r["source"]) for r in names.to_pylist()]
        groups = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        group, known = np.array([groups[p] for p in pairs], np.int64), list(groups)
        langs, sources = pa.array([x for x, _ in known], pa.string()), pa.array([x for _, x in known], pa.string())
        # texts of one group stand together: a slice has few groups, so a term gives few rows
        order = np.argsort(group, kind="stable")
        group = group[order]
        data, offsets = tk.texts_of(b.column(2).cast(pa.large_string()).take(pa.array(order)))
        for i, j, d, o in tk.runs(data, offsets, SLICE_BYTES):
            terms, (t, g, n, docs) = runs_of(d, o, group[i:j], len(known))
            taken = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pc.take(langs, pa.array(g)), pc.take(sources, pa.array(g)), pc.take(taken, pa.array(t)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and the documents that hold the term."""
    texts = pick(docs, "lang", "source", "text").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> F.Column:
    """Smoothed share in whole parts of WHOLE; decimals, as a product may leave 64 bits."""
    return F.expr(f"1 + CAST({WHOLE}BD * CAST({n} + {PRIOR} AS DECIMAL(20, 0)) div CAST({total} + {PRIOR} * {kept} AS DECIMAL(20, 0)) AS BIGINT)")


DIFFERENCES = "lang string, a int, b int, value long, covered long"


def _differences(table: pa.Table, tile: int) -> pa.Table:
    """Sums of differences for the pairs of two tiles of sources, over a block of terms."""
    place, none, p = (table.column(c).to_numpy() for c in ("place", "none", "p"))
    listed = table.column("term").is_valid().to_numpy()
    sources, at = np.unique(place, return_inverse=True)
    zero = np.zeros(len(sources), np.int64)
    zero[at] = none
    term = table.column("term").filter(pa.array(listed)).combine_chunks().dictionary_encode()
    shares = np.repeat(zero[:, None], n_terms := len(term.dictionary), axis=1)
    shares[at[listed], term.indices.to_numpy()] = p[listed]
    ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    edge = int(np.searchsorted(sources, (ta + 1) * tile))
    firsts = [(i, i + 1 if ta == tb else edge) for i in range(edge)]
    a = np.concatenate([np.full(len(sources) - j, sources[i]) for i, j in firsts])
    b = np.concatenate([sources[j:] for _, j in firsts])
    value = np.concatenate([np.abs(shares[j:] - shares[i]).sum(axis=1) for i, j in firsts])
    columns = [pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64()), pa.array(np.full(len(a), n_terms), pa.int64())]
    return pa.Table.from_arrays(columns, ["lang", "a", "b", "value", "covered"])


def pair_sums(shares: DataFrame, groups: DataFrame, tile: int, block_terms: int) -> DataFrame:
    """``lang, a, b, value, covered`` for places a < b: the terms that a block lists are covered."""
    most = groups.agg(F.max("kept"), F.max("place")).first()
    blocks, tiles = -(-(most[0] or 1) // block_terms), (most[1] or 0) // tile + 1
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    # every source stands in every block with the share of a term that it lacks
    marks = groups.filter("kept > 0").select("lang", "place", "none", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rows = shares.select("lang", "place", "none", "term", "p", block.alias("block")).unionByName(marks)
    own = F.floor(F.col("place") / tile).cast("int")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"ta": F.least(own, "other"), "tb": F.greatest(own, "other")}).drop("other")
    sums = dealt.groupBy("lang", "ta", "tb", "block").applyInArrow(lambda t: _differences(t, tile), DIFFERENCES)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, tile: int = TILE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources compared pair by pair, and their outstanding terms."""
    counts = stored(term_counts(docs), "audit-counts")
    kept_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = stored(counts.join(kept_terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit-kept")
    occurring = pick(docs, "lang", "source").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = (
        occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "kept", "lang_total"])
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("none", F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(F.lit(0)))
    )
    groups = stored(groups, "audit-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")})
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    )
    sums = pair_sums(shares, groups, tile, block_terms)
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = sums.select("lang", "value", "covered", F.explode(ways).alias("w")).select("lang", F.col("w.a").alias("place"), F.col("w.b").alias("other"), F.col("value").alias("listed"), "covered")
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("none").alias("other_none"))
    pairs = (
        groups.join(others, "lang").filter("place <> other").join(both, ["lang", "place", "other"], "left")
        .withColumn("value", F.expr("coalesce(listed, 0) + (kept - coalesce(covered, 0)) * abs(none - other_none)"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(best))
    )
    return pairs.unionByName(terms)
