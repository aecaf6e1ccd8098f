"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

Documents come in batches. Each batch gets a suffix array of its sampled suffixes (see
``suffix_kernel``): a run sorted by the bytes of the suffixes. The run is merge-scanned
with the run of each existing level: suffixes that agree are neighbours in byte order.
Then it is added as a level. Levels of equal size are merged, so their sizes grow
geometrically and a suffix is rewritten a logarithmic number of times.

A row of a run holds the suffix's first 16 bytes, by which runs are ordered; suffixes that
agree in them stand together, ordered by hashes of their first gram and of all bytes of
the strings they stand for, so that equal ones are adjacent. Equal rows of a run are
folded to one with their number. Runs are cut into ranges of that order, at borders that
all levels share, and stored in buckets by range: a scan or a merge reads a range of two
runs side by side and moves no row between executors. The borders come from a sample of
SAMPLED suffixes for each range (at most 2 * SAMPLED * MOST_RANGES reach the driver) and
decide nothing but the balance; they may cut through suffixes that share a gram, so a very
frequent gram is spread over many ranges.

Where all bytes of two neighbours agree, all strings of the suffix repeat. Where only the
gram agrees, the bytes of one suffix of each kind are read again from the texts and their
strings compared one by one, which finds the exact edges of a repeat.

Strings are compared by two independent 64-bit hashes, not byte by byte.

Defined cases: null text is empty; texts shorter than ``length`` bytes hold no string and
stay as they are; a very long text is its own run of the kernel, which takes about a
hundred bytes per byte of it; repeated rows are documents of their own (all their strings
repeat); null ids are carried; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from tilewise.llm import textkernel as tk
from tilewise.llm.narrowing import marked
from tilewise.llm.shared import discard, doc_key, doc_stamp, named, new_path, scratch, shuffle_partitions, stored
from tilewise.llm.suffix_kernel import LENGTH, suffixes

BATCHES = 4
#: Bytes of a repeating passage that is reported: passages of over 50 words are longer,
#: unless their words have fewer than three letters on average.
PASSAGE = 200
#: A gram with more kinds of surroundings, or more bytes of them, is compared by a shuffle of string hashes.
HOT_KINDS = 2000
HOT_BYTES = 2 << 20
#: Bytes of snippets that a task compares at once, about.
COMPARED_BYTES = 1 << 19
SUFFIX = ("head", "tail", "gram", "mark")
#: Suffixes of a range, about, and suffixes sampled for its border.
RANGE_ROWS = 100_000
SAMPLED = 32
#: Ranges, at most; where they hold more rows, each is parted further by the hash of the gram.
MOST_RANGES = 4096


def folded(text: np.ndarray, start: np.ndarray, count: np.ndarray, head: np.ndarray, tail: np.ndarray, gram: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adds ``n``: equal suffixes that follow each other in a text become one entry of n.

    Periodic texts would else send one entry for each period to the same place.
    """
    if not len(text):
        return text, start, count, head, tail, gram, mark, count
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + count[:-1])
    at = np.nonzero(new)[0]
    return text[at], start[at], np.add.reduceat(count, at), head[at], tail[at], gram[at], mark[at], np.diff(np.append(at, len(text)))


ENTRY = ("doc", "stamp", "start", "count", *SUFFIX, "n")


def _entries(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.texts_of(b.column(2))
        doc, stamp = np.asarray(b.column(0)), np.asarray(b.column(1))
        for i, _, d, o in tk.runs(data, offsets):
            text, *rest = folded(*suffixes(d, o, length))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[text + i], stamp[text + i], *rest)], list(ENTRY))


RUN = ", ".join(f"{c} long" for c in (*SUFFIX, "n")) + ", range long"
HIT = ", ".join(f"{c} long" for c in SUFFIX) + ", repeated boolean, contested boolean"


def _sort_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One byte string for each row that sorts as its columns do."""
    flipped = [np.asarray(c).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns]
    return np.ascontiguousarray(np.stack(flipped, axis=1).astype(">u8")).view("S32").reshape(-1)


def _ranged(batches: Iterator[pa.RecordBatch], borders: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Adds the range of each suffix, and the part of the range."""
    for b in batches:
        keys = _sort_keys([b.column(k) for k in range(4)])
        part = np.asarray(b.column(2)).view(np.uint64) % np.uint64(parts)
        at = np.searchsorted(borders, keys, "right") * parts + part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*SUFFIX, "n", "range"])


def _in_order(runs: list[pa.Table]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The rows of sorted runs merged: SUFFIX columns, n, number of the run, and starts of equal rows."""
    columns = [np.concatenate([np.asarray(t.column(c)) for t in runs]) for c in (*SUFFIX, "n")]
    run = np.repeat(np.arange(len(runs)), [t.num_rows for t in runs])
    order = np.lexsort(columns[3::-1])
    *suffix, n = (c[order] for c in columns)
    new = np.ones(len(n), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in suffix], axis=0)
    return suffix, n, run[order], np.nonzero(new)[0]


def _merged_run(old: pa.Table, new: pa.Table) -> pa.Table:
    """One run of two, for one range."""
    suffix, n, _, at = _in_order([old, new])
    first = (old if old.num_rows else new).column("range")[0].as_py()
    columns = [c[at] for c in suffix] + [np.add.reduceat(n, at), np.full(len(at), first)]
    return pa.table(dict(zip((*SUFFIX, "n", "range"), columns, strict=True)))


def _merge_scan(new: pa.Table, old: pa.Table, cut: np.ndarray) -> pa.Table:
    """Kinds of suffixes that repeat, or that share a gram with another kind, one of them new.

    ``cut``: grams through which borders run; all their kinds count as sharing them.
    """
    suffix, n, run, at = _in_order([new, old])
    head, tail, gram, mark = (c[at] for c in suffix)
    total, fresh = np.add.reduceat(n, at), np.minimum.reduceat(run, at) == 0
    first = np.ones(len(at), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    group = np.cumsum(first) - 1
    kinds = np.bincount(group)
    touched = np.bincount(group, fresh) > 0
    repeated = fresh & (total > 1)
    contested = touched[group] & ((kinds[group] > 1) | np.isin(gram, cut))
    hit = repeated | contested
    return pa.table({"head": head[hit], "tail": tail[hit], "gram": gram[hit], "mark": mark[hit], "repeated": repeated[hit], "contested": contested[hit]})


class _Levels:
    """The family of suffix arrays: tables in buckets by range, each range sorted by SUFFIX."""

    def __init__(self, entries: DataFrame):
        self.spark = entries.sparkSession
        rows = entries.count()
        ranges = max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
        self.parts = max(1, -(-rows // (ranges * RANGE_ROWS)))
        self.buckets = min(ranges * self.parts, 8 * shuffle_partitions(self.spark))
        share = min(1.0, SAMPLED * ranges / max(rows, 1))
        chosen = F.pmod(F.xxhash64("doc", "stamp", "start"), F.lit(1 << 40)) < int(share * (1 << 40))
        sample = entries.filter(chosen).select(*SUFFIX).limit(2 * SAMPLED * ranges).collect()
        keys = np.sort(_sort_keys(np.array(sample, np.int64).reshape(-1, 4).T))
        self.borders = np.unique(keys[[k * len(keys) // ranges for k in range(1, ranges)]]) if len(keys) else keys
        self.cut = (self.borders.view(">u8").reshape(-1, 4)[:, 2].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        self.tables: dict[str, str] = {}

    def written(self, run: DataFrame) -> str:
        name, path = f"suffix_array_{uuid.uuid4().hex}", new_path(self.spark, "suffix-array")
        run.write.format("parquet").bucketBy(self.buckets, "range").sortBy("range", *SUFFIX).option("path", path).saveAsTable(name)
        self.tables[name] = path
        return name

    def ranges(self, name: str) -> GroupedData:
        return self.spark.table(name).groupBy("range")

    def suffix_array(self, entries: DataFrame) -> str:
        """The sorted run of a batch: a row for each kind of suffix, with their number."""
        kinds = entries.groupBy(*SUFFIX).agg(F.sum("n").alias("n")).mapInArrow(partial(_ranged, borders=self.borders, parts=self.parts), RUN)
        return self.written(kinds.repartition(self.buckets, "range"))

    def merged(self, old: str, new: str) -> str:
        run = self.written(self.ranges(old).cogroup(self.ranges(new)).applyInArrow(_merged_run, RUN))
        self.drop([old, new])
        return run

    def scanned(self, new: str, level: str | None) -> DataFrame:
        """The hits of a new run in a level, or in itself."""
        cut = self.cut

        def alone(run: pa.Table) -> pa.Table:
            return _merge_scan(run, run.slice(0, 0), cut)

        def beside(run: pa.Table, old: pa.Table) -> pa.Table:
            return _merge_scan(run, old, cut)

        if level is None:
            return self.ranges(new).applyInArrow(alone, HIT)
        return self.ranges(new).cogroup(self.ranges(level)).applyInArrow(beside, HIT)

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self.tables.pop(name))


def index_batches(entries: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``head, tail, gram, mark, repeated, contested`` over all batches of ``entries``.

    Levels of equal size are merged when the next batch comes.
    """
    family = _Levels(entries)
    levels: list[tuple[int, str]] = []
    hits = []
    for k in range(batches):
        while len(levels) > 1 and levels[-1][0] == levels[-2][0]:
            (size, new), (_, old) = levels.pop(), levels.pop()
            levels.append((2 * size, family.merged(old, new)))
        new = family.suffix_array(entries.filter(F.pmod(F.xxhash64("doc", "stamp"), F.lit(batches)) == k).select(*SUFFIX, "n"))
        scans = [family.scanned(new, level) for level in [None, *(name for _, name in levels)]]
        hits.append(stored(reduce(DataFrame.unionByName, scans), "suffix-hits"))
        levels.append((1, new))
    family.drop(list(family.tables))
    return reduce(DataFrame.unionByName, hits).groupBy(*SUFFIX).agg(F.max("repeated").alias("repeated"), F.max("contested").alias("contested"))


SNIPPET = "doc long, stamp long, gram long, start long, bytes binary"


def _snippets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted suffixes of each document."""
    out: list[tuple] = []
    size = 0

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["doc", "stamp", "gram", "start", "bytes"])

    for b in batches:
        data, offsets = tk.texts_of(b.column(2))
        for k, (doc, stamp, wanted) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
            for w in wanted:
                at = offsets[k] + w["start"]
                out.append((doc, stamp, w["gram"], w["start"], data[at : at + w["count"] - 1 + length].tobytes()))
                size += len(out[-1][4])
            if size > COMPARED_BYTES:
                yield rows()
                out, size = [], 0
    yield rows()


def _strings(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, hash) of every string of ``length`` bytes of the rows' bytes."""
    prefix = tk.prefix_hash(data)
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + place
    return row, place, tk.span_hash(prefix, at, at + length)


def _runs_of(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of consecutive places of a row."""
    if not len(row):
        return row, place, place
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    end = np.concatenate([new[1:], [True]])
    return row[new], place[new], place[end]


SPANS = "doc long, stamp long, first long, stop long"


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the strings that occur in two kinds of a gram; the rows come sorted by gram."""
    held: list[pa.RecordBatch] = []
    size = 0

    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        data, offsets = tk.texts_of(t.column("bytes"))
        row, place, h = _strings(data, offsets, length)
        gram = np.asarray(t.column("gram"))[row].astype(tk.U)
        _, same, n = np.unique(tk.splitmix(h ^ tk.splitmix(gram)), return_inverse=True, return_counts=True)
        hit = n[same] > 1
        row, first, last = _runs_of(row[hit], place[hit])
        start = np.asarray(t.column("start"))[row]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.asarray(t.column("doc"))[row], np.asarray(t.column("stamp"))[row], start + first, start + last + length)], ["doc", "stamp", "first", "stop"])

    last = None
    for b in batches:
        gram = np.asarray(b.column(2))
        cut = [0, *(np.nonzero(gram[1:] != gram[:-1])[0] + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            if size > COMPARED_BYTES and gram[i] != last:  # whole grams only
                yield spans(held)
                held, size = [], 0
            held.append(b.slice(i, j - i))
            size += sum(map(len, b.column(4).slice(i, j - i).to_pylist()))
            last = gram[i]
    if held:
        yield spans(held)


def _hashed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = tk.texts_of(b.column(4))
        for i, _, d, o in tk.runs(data, offsets, COMPARED_BYTES):
            row, place, h = _strings(d, o, length)
            of = lambda k: np.asarray(b.column(k))[row + i]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of(0), of(1), of(3) + place, of(2), h.astype(np.int64))], ["doc", "stamp", "start", "gram", "hash"])


def repeated_spans(rows: DataFrame, batches: int = BATCHES, length: int = LENGTH) -> DataFrame:
    """``doc, stamp, first, stop``: byte spans covered by repeated strings; they may overlap."""
    with scratch(rows.sparkSession):
        return stored(_found_spans(rows, batches, length), "suffix-found", keep=True)


def _found_spans(rows: DataFrame, batches: int, length: int) -> DataFrame:
    at = partial(_entries, length=length)
    with scratch(rows.sparkSession):
        entries = stored(rows.select("doc", "stamp", "text").mapInArrow(at, ", ".join(f"{c} long" for c in ENTRY)), "suffixes")
        # stored, so that the join's two sides are plain shuffles and a frequent suffix can be split
        kinds = stored(index_batches(entries, batches), "suffix-kinds")
        met = stored(entries.join(kinds, list(SUFFIX)), "suffix-met", keep=True)
    whole = met.filter("repeated").select("doc", "stamp", F.col("start").alias("first"), (F.col("start") + F.col("count") - 1 + length).alias("stop"))
    one = stored(met.filter("contested").groupBy(*SUFFIX).agg(F.min(F.struct("doc", "stamp", "start", "count")).alias("e")).select("gram", "e.*"), "suffix-one")
    hot = stored(one.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.col("count") + length).alias("bytes")).filter((F.col("kinds") > HOT_KINDS) | (F.col("bytes") > HOT_BYTES)).select("gram"), "suffix-hot")
    wanted = stored(one.groupBy("doc", "stamp").agg(F.collect_list(F.struct("gram", "start", "count")).alias("wanted")), "suffix-wanted")
    thin, maybe = marked(rows, "stamp", wanted, "stamp")
    bytes_of = thin.filter(maybe).select("doc", "stamp", "text").dropDuplicates(["doc", "stamp"]).join(wanted, ["doc", "stamp"])
    snippets = stored(bytes_of.select("doc", "stamp", "text", "wanted").mapInArrow(partial(_snippets, length=length), SNIPPET), "suffix-bytes")
    n = shuffle_partitions(rows.sparkSession)
    grouped = snippets.join(hot, "gram", "left_anti").select("doc", "stamp", "gram", "start", "bytes").repartition(n, "gram").sortWithinPartitions("gram")
    few = grouped.mapInArrow(partial(_compared, length=length), SPANS)
    spans = whole.unionByName(few)
    if not hot.take(1):
        return spans
    hot_bytes = snippets.join(hot, "gram").select("doc", "stamp", "gram", "start", "bytes")
    hashes = stored(hot_bytes.mapInArrow(partial(_hashed, length=length), "doc long, stamp long, start long, gram long, hash long"), "suffix-strings")
    twice = stored(hashes.groupBy("gram", "hash").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-twice")
    many = hashes.join(twice, ["gram", "hash"]).select("doc", "stamp", F.col("start").alias("first"), (F.col("start") + length).alias("stop"))
    return spans.unionByName(many)


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its covered bytes; a fourth column has spans that are only measured."""
    for b in batches:
        data, offsets = tk.texts_of(b.column(1))
        passages = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        out: list[tuple] = []
        for k, spans in enumerate(b.column(2).to_pylist()):
            raw = data[offsets[k] : offsets[k + 1]].tobytes()
            gone = covered([(s["first"], s["stop"]) for s in spans or []])
            edges = [0, *(x for pair in gone for x in pair), len(raw)]
            rest = b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
            shared = sum(e - a for a, e in covered([(s["first"], s["stop"]) for s in passages[k] or []]))
            out.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), shared, rest.decode("utf-8", "ignore")))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], CUT)


CUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept_text"]


def _cut_texts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The named columns, with covered bytes cut from ``text``; the last column has the spans."""
    at = names.index("text")
    for b in batches:
        spans = b.column(b.num_columns - 1)
        rest = next(_cut(iter([pa.RecordBatch.from_arrays([b.column(at), b.column(at), spans], ["doc_id", "text", "spans"])]))).column(6)
        has = pa.array([bool(x) for x in spans.to_pylist()], pa.bool_())
        text = pc.if_else(has, rest, b.column(at).cast(pa.string()))
        yield pa.RecordBatch.from_arrays([text if k == at else b.column(k) for k in range(len(names))], names)


SEGMENT = "doc long, stamp long, segment long, place long, bytes binary"


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The runs of ``length`` bytes or more that the spans of each document cover."""
    for b in batches:
        data, offsets = tk.texts_of(b.column(2))
        out: list[tuple] = []
        for k, spans in enumerate(b.column(3).to_pylist()):
            doc, stamp = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            for first, stop in covered([(s["first"], s["stop"]) for s in spans]):
                if stop - first >= length:
                    name = int.from_bytes(hashlib.blake2b(f"{stamp} {first}".encode(), digest_size=8).digest(), "little", signed=True)
                    out.append((doc, stamp, name, first, data[offsets[k] + first : offsets[k] + stop].tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["doc", "stamp", "segment", "place", "bytes"])


def _longer(rows: DataFrame, shorter: DataFrame, batches: int, length: int) -> DataFrame:
    """Spans of repeated strings of ``length`` bytes, given those of shorter strings.

    Every shorter string inside a repeated one repeats too, so the longer ones lie in the
    runs that the shorter ones cover. Only these runs are indexed, as texts of their own.
    """
    held = shorter.groupBy("doc", "stamp").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    held = stored(held, "suffix-covered")
    thin, maybe = marked(rows, "stamp", held, "stamp")
    met = thin.filter(maybe).join(held, ["doc", "stamp"]).select("doc", "stamp", "text", "spans")
    segments = stored(met.mapInArrow(partial(_segments, length=length), SEGMENT), "suffix-segments")
    found = repeated_spans(segments.select("doc", F.col("segment").alias("stamp"), F.col("bytes").alias("text")), batches, length)
    at = segments.select("doc", "stamp", "segment", "place").distinct()
    back = found.withColumnRenamed("stamp", "segment").join(at, ["doc", "segment"])
    return back.select("doc", "stamp", (F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("stop")).alias("stop"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, kept_text`` of each document.

    ``n_passage_bytes`` counts the bytes covered by strings of ``passage`` bytes (at most
    ``length``) that also start elsewhere: passages that repeat, but may be too short to be
    removed. They are found first; strings of ``length`` bytes are looked for inside them.
    ``kept_text`` holds the remaining bytes as text; halves of a character that a cut
    leaves behind are dropped from it (not from the digest). It is null where nothing
    repeats: the text stays as it is.
    """
    if not 0 < passage <= length:
        raise ValueError("a passage is at most as long as a string that is removed")
    rows = named(docs)
    short = repeated_spans(rows, batches, passage)
    both = _longer(rows, short, batches, length).withColumn("short", F.lit(False)).unionByName(short.withColumn("short", F.lit(True)))
    span = F.struct("first", "stop")
    spans = stored(both.groupBy("doc", "stamp").agg(F.collect_set(F.when(~F.col("short"), span)).alias("spans"), F.collect_set(F.when(F.col("short"), span)).alias("passages")), "suffix-spans")
    thin, maybe = marked(rows, "stamp", spans, "stamp")
    zero = F.lit(0).cast("long")
    intact = thin.filter(~maybe).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), zero.alias("n_passage_bytes"), F.lit(None).cast("string").alias("kept_text"),
    )
    joined = thin.filter(maybe).join(spans, ["doc", "stamp"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept_text string"
    return intact.unionByName(joined.select("doc_id", "text", "spans", "passages").mapInArrow(_cut, schema))


def without_repeats(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, with repeated strings cut from their texts."""
    rows = docs.withColumn("__stamp", doc_stamp()).withColumn("__doc", doc_key())
    spans = stored(repeated_spans(named(docs), batches, length).groupBy("doc", "stamp").agg(F.collect_set(F.struct("first", "stop")).alias("spans")), "suffix-spans")
    thin, maybe = marked(rows, "__stamp", spans, "stamp")
    s = spans.select(F.col("doc").alias("__doc"), F.col("stamp").alias("__stamp"), F.col("spans").alias("__spans"))
    joined = thin.filter(maybe).join(s, ["__doc", "__stamp"], "left")
    return thin.filter(~maybe).select(*docs.columns).unionByName(joined.select(*docs.columns, "__spans").mapInArrow(partial(_cut_texts, names=docs.columns), docs.schema))
