"""WARC archives: writing, reading back, and an externally merged capture index.

Payloads that occur more than once are stored once: the capture with the largest page
id is the response, the others are revisit records that refer to it. Archives are
written and read with Spark's own file sources, so any file system that Spark knows
will do. Each archive read back gives a locally sorted run of captures; the runs are
dealt by ranges of (URL key, time, page, place) and each range is merged by a loser tree, so
one URL with very many captures, even at one time and without ids, is spread over several
ranges.

Defined cases: null html is an empty payload; null url leaves the target header out;
rows that repeat a page id are captures of their own (all rows with the largest id of
a payload are responses); null ids are kept and never referred to unless all ids of the
payload are null; control characters of a URL are percent-encoded; a malformed URL is its
own key; a very long page is one record, held whole by one task; extra columns are
ignored; an empty table writes an empty archive folder and gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.llm.narrowing import marked
from tilewise.llm.shared import new_path, pick, shuffle_partitions, stored

END = "\r\n\r\n"
START = datetime(2020, 1, 1, tzinfo=UTC)
#: Bound on the records of one archive file, and so on what a reading task holds.
ARCHIVE_RECORDS = 2000
#: Captures of one range of the index, about: what a merging task holds.
RANGE_ROWS = 50_000
CAPTURE = "archive string, record_offset long, record_length long, page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from right to left, then path and sorted query; the URL itself if it is malformed."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + query if query else "")


def _header_safe(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x21 or ord(c) == 0x7F else c for c in text)


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> str:
    """One WARC record without its closing blank lines; refers_to: None for a response."""
    n = len(html.encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    block = http + (html if refers_to is None else "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        f"WARC-Date: {(START + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block.encode())}",
    ]
    head += [f"WARC-Target-URI: {_header_safe(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    return "\r\n".join(head) + END + block


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
        out = [record(p, u, h, payload_digest(h.encode()), None if first is None or p == first else first) for p, u, h, first in rows]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of all pages below ``path``; payloads are matched by digest."""
    spark = pages.sparkSession
    digested = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha1("html")).withColumn("hash", F.xxhash64("digest"))
    # payloads are matched by digests and ids alone, and only those that repeat (and a few
    # that a bitmap can't tell from them) are dealt by digest
    repeated = digested.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    first = stored(repeated.select("digest", "response", F.xxhash64("digest").alias("hash")), "warc-repeated")
    thin, maybe = marked(digested, "hash", first, "hash")
    columns = ["page_id", "url", "html"]
    met = thin.filter(maybe).select(*columns, "digest").join(first.select("digest", "response"), "digest", "left").select(*columns, "response")
    rows = thin.filter(~maybe).select(*columns, F.lit(None).cast("long").alias("response")).unionByName(met)
    (
        rows.mapInArrow(_recorded, "value string")
        .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS)
        .text(path)
    )


def parse_archive(name: str, data: bytes) -> list[tuple]:
    """The captures of one archive, sorted: a local run. Damaged payloads raise."""
    at, out = 0, []
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        http, _, payload = data[begin:end].partition(b"\r\n\r\n")
        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != n or payload_digest(payload) != digest):
            raise ValueError(f"{name}: the payload at {at} doesn't match its digest")
        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
        url = head.get("WARC-Target-URI")
        out.append((name, at, end - at, page and int(page), url, url_key(url), head["WARC-Date"], head["WARC-Type"], n, digest, refers and int(refers)))
        at = end + 4
    return sorted(out, key=_order)


def _order(capture: tuple) -> tuple:
    """URL key, time and page, null ids first; then the place, so that no two captures are equal."""
    page = capture[3]
    return capture[5], capture[6], page is not None, page or 0, capture[0], capture[1]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([int(r[k]) if pa.types.is_int64(t) and r[k] is not None else r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            content = b.column(1)[k].as_py()
            yield _rows(parse_archive(b.column(0)[k].as_py().rsplit("/", 1)[-1], gzip.decompress(content)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record below ``path``; the rows of one archive are a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_parsed, CAPTURE)


class LoserTree:
    """K-way merge: each inner node holds the loser of its match, the root the winner."""

    def __init__(self, sources: list[Iterator], key: Callable):
        self.sources, self.key = sources, key
        self.k = max(1, len(sources))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: used up, loses to all
        self.losers = [-1] * self.k
        for i in range(len(sources)):
            self._advance(i)
        for i in range(self.k):
            self._settle(i)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _settle(self, i: int) -> None:
        """Play source i up the tree; the first to come waits at an empty node."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.sources and self.keys[w := self.losers[0]] is not None:
            yield self.heads[w]
            self._advance(w)
            self._settle(w)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index: its pieces of the runs, merged in order.

    The ranges are so many that one holds about RANGE_ROWS captures, whatever the table.
    """
    pieces: dict[tuple[str, int], list[tuple]] = {}
    part: dict[str, int] = {}
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = (r[0], part.get(r[0], 0))
            if at in pieces and _order(pieces[at][-1]) > _order(r):  # a run that arrived in two orders is two runs
                part[r[0]] = at[1] + 1
                at = (r[0], at[1] + 1)
            pieces.setdefault(at, []).append(r)
    merged: list[tuple] = []
    for r in LoserTree([iter(x) for x in pieces.values()], _order):
        merged.append(r)
        if len(merged) == 10_000:
            yield _rows(merged)
            merged = []
    if merged:
        yield _rows(merged)


def merge_index(runs: DataFrame) -> DataFrame:
    """Captures in global order of (url_key, captured, page_id) over the partitions."""
    n = max(shuffle_partitions(runs.sparkSession), -(-runs.count() // RANGE_ROWS))
    order = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "record_offset"]
    return runs.repartitionByRange(n, *order).mapInArrow(_merged, CAPTURE)


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return merge_index(stored(read_archives(spark, path), "warc-runs"))
