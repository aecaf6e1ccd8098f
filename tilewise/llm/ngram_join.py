"""Near-duplicate groups by an exact Jaccard join on word shingles.

Signatures are token-combination prefixes. The shingles of a set are ordered from rare
to frequent; a prefix is taken that is long enough for any partner of the wanted
similarity to share part of it. Rare shingles are indexed alone. Frequent ones are parted
into groups by hash and indexed by pairs of a group's shingles: a group of c prefix
shingles survives the loss of c - 2 of them, so the prefix is extended until the groups
together survive every loss that the similarity allows. (With small sets, all are
indexed alone.)

Sets that share a signature are candidates. Equal sets are one node from the start. A
signature's place in the order of a set bounds what the set can share with one that it
first meets there; nodes that this and the sizes rule out leave the list. Signatures with
the same nodes are one list.
Every node has a small bitmap that bounds the symmetric difference of two sets from below,
so most candidates are ruled out without their texts. Neighbours in each signature's list
are verified first, for each node the one with which it shares most signatures. In long lists, each node is then compared
with a block of bounded size of its shortest and of its longest list, inside a task and
by exact sets. Nodes that links join need no further comparison. What remains are pairs
of nodes in different components. Lists of few nodes meet inside tasks and give the pairs
that the bitmaps don't rule out; the texts of these are compared. Long lists give no pairs: the nodes outside the largest
component are compared with all others block by block inside tasks, as bitmaps first. A
block's rows that these don't rule out are compared as sets, and the block returns
as many links as join its nodes, at most one for each. All verification is exact on
64-bit shingle hashes.

Which shingles count as frequent only affects speed, not results.

Defined cases: null or blank texts have an empty set, link with nothing and are their own
component (their id); fewer words than the shingle size make one shingle; repeated rows
are documents of their own and link with each other; null ids are never a component's
smallest id while another one is there; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.llm import textkernel as tk
from tilewise.llm.components import connected_components
from tilewise.llm.narrowing import marked
from tilewise.llm.shared import doc_key, doc_stamp, named, scratch, shuffle_partitions, stored

WORDS = 5
PERCENT = 75
#: Frequent shingles that every task knows, at most: a table of fixed size.
FREQUENT = 1 << 16
#: A shingle is reported as frequent by a task that sees it so often in one go.
SEEN_OFTEN = 4
#: Shingles that a task counts in one go.
COUNT_AT_ONCE = 1 << 20
#: Sets below this size index all shingles alone.
SMALL = 16
#: Lists longer than this are compared block by block.
LONG_LIST = 48
#: Nodes, and their shingles, that a task compares with each other at once, about.
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
#: Rows of blocks that a task gets, about.
ROWS_OF_A_TASK = 20_000
#: A shingle of at most so many sets of a block is counted pair by pair.
FEW_SETS = 8
COLUMNS = 2048
#: Pairs whose sets a task holds at once.
PAIRS_AT_ONCE = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    n = len(offsets) - 1
    _, _, of, h = tk.word_hashes(data, offsets, tk.SPACE_DELIMS, True)
    count = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    at, shingle = tk.windows(h, of, WORDS)
    cut = np.searchsorted(at, first)
    out = []
    for k in range(n):
        if count[k] >= WORDS:
            out.append(np.unique(shingle[cut[k] : cut[k + 1]]))
        elif count[k]:
            out.append(tk.windows(h[first[k] : first[k + 1]], of[first[k] : first[k + 1]], int(count[k]))[1])
        else:
            out.append(np.zeros(0, tk.U))
    return out


def node_of(s: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = tk.splitmix(s).sum(dtype=tk.U) + tk.U(len(s)) * tk.U(0x9E3779B97F4A7C15)
    return int(tk.splitmix(np.array([total], tk.U)).astype(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, doc, stamp, set size, node, bitmap of each row; kind 1: a shingle and how often it was seen."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n >= SEEN_OFTEN].astype(np.int64), n[n >= SEEN_OFTEN]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), none, pa.array(token), none, pa.array(n), none, pa.nulls(len(token), pa.binary())], NAMES)

    held, size = [], 0
    for b in batches:
        data, offsets = tk.texts_of(b.column(3))
        sizes, nodes, maps = [], [], []
        for _, _, d, o in tk.runs(data, offsets):
            for s in shingle_sets(d, o):
                maps.append(bitmap(s))
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                held.append(s)
                size += len(s)
            if size >= COUNT_AT_ONCE:
                yield often(held)
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary())], NAMES)
    if held:
        yield often(held)


NAMES = ["kind", "doc_id", "a", "b", "n", "node", "bitmap"]


def allowed_loss(n: int, percent: int) -> int:
    """Shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def size_class(n: int) -> int:
    """0 for small sets, else the power of two below the size."""
    return 0 if n < SMALL else n.bit_length()


def signatures(s: np.ndarray, frequent: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes of a sorted set, and the reach of each.

    ``frequent``: sorted shingles, ``level``: how frequent each is. The reach bounds the
    intersection of this set with any for which the signature is the first that both have,
    in the order in which signatures are completed: before its last shingle, common ones
    are frequent and of different groups, or they would have completed another one.
    """
    n = len(s)
    at = np.minimum(np.searchsorted(frequent, s), max(len(frequent) - 1, 0))
    is_frequent = frequent[at] == s if len(frequent) else np.zeros(n, bool)
    rank = np.where(is_frequent, level[at], 0) if len(frequent) else np.zeros(n, np.int64)
    order = np.lexsort((s, rank))
    s, is_frequent = s[order], is_frequent[order]
    loss = allowed_loss(n, percent)
    out, reach = [], []
    for cls in {size_class(n), size_class(100 * n // percent)}:
        if not cls:
            out.append(s[: loss + 1])
            reach.append(n - np.arange(min(loss + 1, n)))
            continue
        # two sets meet in the class of the larger one: in the class above its own, a set has larger partners only
        least = -(-percent * n // 100) if cls == size_class(n) else 1 << (cls - 1)
        enough = lambda r: largest_partner(n, r, percent) >= least  # noqa: B023, E731
        parts = np.uint64(max(1, (1 << (cls - 1)) // 8))
        group = np.where(is_frequent, (tk.splitmix(s + tk.U(cls)) % parts).astype(np.int64), -1)
        # each rare shingle survives one more loss, a group's first shingle none
        first = np.zeros(n, bool)
        first[np.unique(group, return_index=True)[1]] = True
        gain = np.cumsum(~is_frequent | ~first)
        stop = int(np.searchsorted(gain, loss + 1)) + 1
        opened = first & is_frequent
        bound = np.cumsum(opened) - opened + n - np.arange(n)  # groups met before a place, and what stands from there on
        rare = np.nonzero(~is_frequent[:stop])[0]
        rare = rare[enough(bound[rare])]
        out.append(s[rare])
        reach.append(bound[rare])
        for k in np.unique(group[:stop][is_frequent[:stop]]):
            place = np.nonzero(group[:stop] == k)[0]
            place = place[np.argsort(s[place])]
            i, j = np.triu_indices(len(place), 1)
            some = enough(bound[np.maximum(place[i], place[j])])
            i, j = i[some], j[some]
            out.append(tk.splitmix(s[place[i]] * tk.U(3) + tk.splitmix(s[place[j]] + tk.U(cls))))
            reach.append(bound[np.maximum(place[i], place[j])])
    if not out:
        return s, np.zeros(0, np.int64)
    sig, reach = np.concatenate(out), np.concatenate(reach)
    order = np.lexsort((-reach, sig))  # of a signature in both classes the larger reach counts
    sig, reach = sig[order], reach[order]
    kept = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    return sig[kept], reach[kept]


def largest_partner(n: np.ndarray, reach: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that one of size n can link with, if they share ``reach`` shingles at most."""
    return (100 + percent) * reach // percent - n


def _signed(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, level: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each signature of each node; a task sends a node's rows once."""
    sent: set[int] = set()
    for b in batches:
        data, offsets = tk.texts_of(b.column(0))
        for _, _, d, o in tk.runs(data, offsets):
            sigs, nodes, sizes, most = [], [], [], []
            for s in shingle_sets(d, o):
                if not len(s) or (node := node_of(s)) in sent:
                    continue
                sent.add(node)
                got, reach = signatures(s, frequent, level, percent)
                sigs.append(got)
                nodes.append(np.full(len(got), node))
                sizes.append(np.full(len(got), len(s), np.int32))
                most.append(largest_partner(len(s), reach, percent).astype(np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(most))], ["sig", "node", "n", "most"])


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each of one to two times their number of bits."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    at = (s & tk.U(bits - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Set bits of a xor b: never more than the symmetric difference of the sets.

    The wider bitmap is folded onto the narrower.
    """
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the bitmaps don't rule out, with how far apart they are at least."""
    for b in batches:
        nu, nv, x, y = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
        apart = np.array([_apart(p, q) for p, q in zip(x, y, strict=True)], np.int64)
        total = np.array(nu, np.int64) + np.array(nv, np.int64)
        # with d apart at least, the intersection is (total - d) / 2 at most
        both = (total - apart) // 2
        keep = pa.array(100 * both >= percent * (total - both))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(apart).filter(keep)], ["u", "v", "apart"])


def list_pairs(sig: np.ndarray, part: np.ndarray, n: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``i < j`` of rows of one list whose sizes, reaches and parts let them link; rows come sorted by ``sig``."""
    left, right = [], []
    for lag in range(1, len(sig)):
        same = sig[lag:] == sig[:-lag]
        if not same.any():
            break
        i = np.nonzero(same)[0]
        j = i + lag
        hit = (part[i] != part[j]) & (n[i] <= most[j]) & (n[j] <= most[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        left.append(i[hit])
        right.append(j[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _listed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs inside lists of few nodes that the bitmaps don't rule out; rows come sorted by ``sig``."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        sig, node, part, n, most = (t.column(c).to_numpy().astype(np.int64) for c in ("sig", "node", "part", "n", "most"))
        maps = t.column("bitmap").to_pylist()
        i, j = list_pairs(sig, part, n, most, percent)
        apart = np.array([_apart(maps[a], maps[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        both = np.minimum((n[i] + n[j] - apart) // 2, np.minimum(n[i], n[j]))
        hit = 100 * both >= percent * (n[i] + n[j] - both)
        u, v = node[i[hit]], node[j[hit]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # the last list of a batch may go on in the next one
        sig = b.column(0).to_numpy()
        last = int(np.nonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))[0][-1])
        if held and held[-1].column(0)[-1].as_py() != sig[0]:
            yield pairs(pa.Table.from_batches(held))
            held = []
        if last:
            yield pairs(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        held.append(b.slice(last))
    if held:
        yield pairs(pa.Table.from_batches(held))


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts reach the similarity."""
    for whole in batches:
        for first in range(0, whole.num_rows, PAIRS_AT_ONCE):
            b = whole.slice(first, PAIRS_AT_ONCE)
            left = [s for _, _, d, o in tk.runs(*tk.texts_of(b.column(2))) for s in shingle_sets(d, o)]
            right = [s for _, _, d, o in tk.runs(*tk.texts_of(b.column(3))) for s in shingle_sets(d, o)]
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], ["u", "v"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``."""
    n, m = len(left), len(right)
    out = np.zeros(n * m, np.int64)
    token = np.concatenate([*left, *right])
    at = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    order = np.lexsort((at, token))
    token, at = token[order], at[order]
    cut = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
    group = np.cumsum(np.bincount(cut, minlength=len(token))) - 1
    on_left = np.bincount(group, at < n, minlength=len(cut)).astype(np.int64)
    size = np.diff(np.append(cut, len(token)))
    common = (on_left > 0) & (on_left < size)
    few = common & (size <= FEW_SETS)
    # shingles of few sets: each entry meets the ones that follow it
    keep = few[group]
    g, a = group[keep], at[keep]
    for lag in range(1, FEW_SETS):
        hit = np.nonzero((g[lag:] == g[:-lag]) & (a[:-lag] < n) & (a[lag:] >= n))[0]
        out += np.bincount(a[hit] * m + a[hit + lag] - n, minlength=n * m)
    # shingles of many sets: products of incidence matrices, some columns at a time
    keep = (common & ~few)[group]
    column, a = group[keep], at[keep]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    total = np.zeros((n, m), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [first, first + COLUMNS])
        x = np.zeros((n + m, COLUMNS), np.float32)
        x[a[i:j], column[i:j] - first] = 1
        total += x[:n] @ x[n:].T
    return out.reshape(n, m) + total.astype(np.int64)


def spanning(n: int, pairs: np.ndarray) -> list[int]:
    """Positions of pairs that join 0 .. n - 1 as much as all pairs do."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (a, b) in enumerate(pairs.tolist()):
        p, q = root(a), root(b)
        if p != q:
            up[p] = q
            out.append(k)
    return out


def block_links(side: np.ndarray, node: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sides of a block, enough to join what its links join.

    ``side`` 0, 1, or 2 for rows that are compared with each other. Rows of one part need
    no link. A block has a bounded number of rows.
    """
    left, right = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in sets])
    both = intersections([sets[k] for k in left], [sets[k] for k in right])
    hit = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (part[left][:, None] != part[right][None, :])
    i, j = np.nonzero(hit)
    pairs = np.stack([left[i], right[j]], axis=1)
    return [(int(node[a]), int(node[b])) for a, b in pairs[spanning(len(side), pairs)]]


def possible(side: np.ndarray, part: np.ndarray, n: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Which rows of a block may link with a row of another part, by sizes and bitmaps.

    ``side`` as in ``block_links``; ``n`` has the sizes of the sets.
    """
    keep = np.zeros(len(side), bool)
    width = np.array([len(m) for m in maps])
    for w in np.unique(width):
        for v in np.unique(width):
            if max(w, v) > 2 * min(w, v):  # the larger set has more than twice the shingles
                continue
            i, j = np.nonzero((width == w) & (side != 1))[0], np.nonzero((width == v) & (side != 0))[0]
            if not len(i) or not len(j):
                continue
            x, y = (np.frombuffer(b"".join(maps[k] for k in at), "<u8").reshape(len(at), -1) for at in (i, j))
            words = min(x.shape[1], y.shape[1])
            x, y = (m if m.shape[1] == words else m[:, :words] ^ m[:, words:] for m in (x, y))
            apart = np.zeros((len(i), len(j)), np.int64)
            for k in range(words):
                apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
            total = n[i][:, None] + n[j][None, :]
            both = np.minimum((total - apart) // 2, np.minimum(n[i][:, None], n[j][None, :]))
            hit = (100 * both >= percent * (total - both)) & (part[i][:, None] != part[j][None, :])
            keep[i[hit.any(axis=1)]] = True
            keep[j[hit.any(axis=0)]] = True
    return keep


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; they come sorted by block (``a, b, c``, the first columns)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in range(3)])
        cut = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:], strict=False):
            if held and tuple(key[:, i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = tuple(key[:, i])
    if held:
        yield pa.Table.from_batches(held)


def _possible_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of each block that may link with another part there."""
    for t in _blocks(batches):
        side, part, n = (np.asarray(t.column(c)).astype(np.int64) for c in ("side", "part", "n"))
        keep = possible(side, part, n, t.column("bitmap").to_pylist(), percent)
        if keep.any():
            yield from t.drop_columns(["n", "bitmap"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _linked_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each block."""
    for t in _blocks(batches):
        if t.num_rows > 1:
            sets = [s for _, _, d, o in tk.runs(*tk.texts_of(t.column("text"))) for s in shingle_sets(d, o)]
            found = block_links(*(np.asarray(t.column(c)) for c in ("side", "node", "part")), sets, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


class _Join:
    """The steps of one join, over the tables that they share."""

    def __init__(self, docs: DataFrame, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("signatures look at two size classes, which holds from 50 percent on")
        self.percent = percent
        self.rows = named(docs)
        found = stored(self.rows.select("doc_id", "doc", "stamp", "text").mapInArrow(_sets, "kind int, doc_id long, a long, b long, n long, node long, bitmap binary"), "shingle-sets")
        self.sets = found.filter("kind = 0").select("doc_id", F.col("a").alias("doc"), F.col("b").alias("stamp"), "n", "node", "bitmap")
        often = found.filter("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
        tokens = np.array([r[0] for r in often], np.int64).astype(tk.U)
        order = np.argsort(tokens)
        self.frequent = tokens[order]
        self.level = np.array([int(r[1]).bit_length() for r in often], np.int64)[order]

    def lists(self) -> DataFrame:
        """``sig, node, n, most, size, before, sigs`` of signatures that two nodes or more share.

        ``most`` is the size of the largest set with which a node can link if they first meet
        in this list. A node stays in a list only if another one of fitting size is there, and
        one for which the node isn't too large: every pair that links passes where it first meets.
        A passage that the same nodes share gives many signatures with one list: a list is
        named by what it holds and comes once, with the largest ``most`` of each node and the
        number of its signatures, ``sigs``. Lists
        of one name and size that differ would only meet as one.
        """
        signed = self.rows.select("text").mapInArrow(partial(_signed, frequent=self.frequent, level=self.level, percent=self.percent), "sig long, node long, n int, most int")
        by = W.partitionBy("sig")
        ordered = by.orderBy("node")
        once = signed.withColumn("before", F.lag("node").over(ordered)).filter("before IS NULL OR before <> node")  # a node that several tasks sent
        of_list = {"size": F.count("*").over(by), "least_n": F.min("n").over(by), "most_most": F.max("most").over(by)}
        once = once.withColumns(of_list).filter("size > 1 AND most >= least_n AND n <= most_most").select("sig", "node", "n", "most")
        by_size = by.orderBy("n", "node")
        others = {"smaller": F.lag("n").over(by_size), "larger": F.lead("n").over(by_size), "sum_most": F.sum("most").over(by)}
        for _ in range(2):
            met = once.withColumns(of_list | others).filter(
                f"size > 1 AND ((100L * smaller >= {self.percent}L * n AND most >= least_n) OR most >= larger) AND n <= IF(size = 2, sum_most - most, most_most)"
            )
            once = met.select("sig", "node", "n", "most")
        held = {"before": F.lag("node").over(ordered), "size": F.count("*").over(by), "held": F.bit_xor(F.xxhash64("node")).over(by)}
        each = once.withColumns(held).filter("size > 1").groupBy(F.col("held").alias("sig"), "size", "node")
        return each.agg(F.first("n").alias("n"), F.max("most").alias("most"), F.min("before").alias("before"), F.count("*").alias("sigs"))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """``u, v, apart``: the pairs that sizes and bitmaps don't rule out."""
        of = lambda c, n, m: self.nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("bitmap").alias(m))
        sized = pairs.select("u", "v").join(of("u", "nu", "x"), "u").join(of("v", "nv", "y"), "v").filter(f"100 * least(nu, nv) >= {self.percent} * greatest(nu, nv)")
        return sized.select("u", "v", "nu", "nv", "x", "y").mapInArrow(partial(_bounded, percent=self.percent), "u long, v long, apart long")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``node, text`` of the wanted nodes (a column ``node``), each once."""
        one = stored(self.nodes.join(wanted.select("node").distinct(), "node").select("node", "doc", "stamp"), "join-nodes")
        thin, maybe = marked(self.rows.select("doc", "stamp", "text"), "stamp", one, "stamp")
        return stored(thin.filter(maybe).dropDuplicates(["doc", "stamp"]).join(one, ["doc", "stamp"]).select("node", "text"), "join-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among the pairs, by the sets of both texts."""
        with scratch(self.rows.sparkSession):
            texts = self.texts(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
            right = pairs.select("u", "v").join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
            both = right.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
            return stored(both.select("u", "v", "x", "y").mapInArrow(partial(_linked, percent=self.percent), "u long, v long"), "join-links", keep=True)

    def inside_short(self, short: DataFrame) -> DataFrame:
        """``u, v``: pairs of lists of few nodes that may link. They meet inside tasks, so what is shuffled grows with the lists' nodes."""
        with_map = short.select("sig", "node", "part", "n", "most").join(self.nodes.select("node", "bitmap"), "node").select("sig", "node", "part", "n", "most", "bitmap")
        by_list = with_map.repartition(shuffle_partitions(short.sparkSession), "sig").sortWithinPartitions("sig")
        return by_list.mapInArrow(partial(_listed, percent=self.percent), "u long, v long")

    def in_blocks(self, dealt: DataFrame, rows: int) -> DataFrame:
        """Spanning links of the blocks of ``dealt``: ``a, b, c`` (the block), ``side, node, part``.

        The blocks meet as bitmaps first; texts follow only of rows that may link.
        """
        n = max(shuffle_partitions(dealt.sparkSession), -(-rows // ROWS_OF_A_TASK))
        by_block = lambda t: t.repartition(n, "a", "b", "c").sortWithinPartitions("a", "b", "c")
        with scratch(self.rows.sparkSession):
            with_map = dealt.join(self.nodes.select("node", "n", "bitmap"), "node").select("a", "b", "c", "side", "node", "part", "n", "bitmap")
            maybe = stored(by_block(with_map).mapInArrow(partial(_possible_rows, percent=self.percent), "a long, b long, c long, side int, node long, part long"), "join-possible")
            with_text = maybe.join(self.texts(maybe), "node").select("a", "b", "c", "side", "node", "part", "text")
            return stored(by_block(with_text).mapInArrow(partial(_linked_blocks, percent=self.percent), "u long, v long"), "join-links", keep=True)

    def inside_lists(self, lists: DataFrame, salt: int) -> DataFrame:
        """Links inside blocks of each node's shortest and longest list."""
        tokens = stored(lists.groupBy("sig").agg(F.sum("n").alias("tokens")), "join-tokens")
        lists = stored(lists.join(tokens, "sig"), "join-sized")
        size = F.struct("size", "sig", "tokens")
        ends = lists.groupBy("node").agg(F.first("part").alias("part"), F.min(size).alias("low"), F.max(size).alias("high"))
        chosen = ends.select("node", "part", F.explode(F.array_distinct(F.array("low", "high"))).alias("l")).select("node", "part", "l.*")
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("tokens") / BLOCK_SHINGLES))
        dealt = chosen.select(F.col("sig").alias("a"), F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(2).alias("side"), "node", "part")
        return self.in_blocks(dealt, lists.count())

    def parted(self, lists: DataFrame, links: DataFrame) -> DataFrame:
        """The lists whose nodes the links don't join yet, with the ``part`` of each node."""
        with scratch(self.rows.sparkSession):
            parts = connected_components(links).select("node", F.col("component_id").alias("part"))
            member = stored(lists.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "join-parts")
            ends = member.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
            # stored, so that the join's two sides are plain shuffles and a long list can be split
            open_lists = stored(ends.select("sig"), "join-open")
            return stored(member.join(open_lists, "sig"), "join-apart", keep=True)

    def links(self) -> DataFrame:
        """Enough of the links to give the components: ``u, v``."""
        lists = stored(self.lists(), "join-lists")
        met = self.sets.join(lists.select("node").distinct(), "node")
        self.nodes = stored(met.groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min(F.struct("doc", "stamp")).alias("r")).select("node", "n", "bitmap", "r.doc", "r.stamp"), "join-bitmaps")
        near = lists.filter("before IS NOT NULL").groupBy(F.col("before").alias("u"), F.col("node").alias("v")).agg(F.sum("sigs").alias("shared"))
        # one pair per node, with the neighbour that shares most signatures, so that only its bitmaps are
        # dealt: the others, and nodes that share one signature only, come again below if they still part components
        nearest = near.filter("shared > 1").groupBy("v").agg(F.max(F.struct("shared", "u")).alias("b")).select("b.u", "v")
        found = self.verified(stored(self.bounded(nearest), "join-near"))
        lists = self.parted(lists, found)
        for salt in (0, 1):  # blocks that are dealt anew join the blocks of the first deal
            long = lists.filter(F.col("size") > (BLOCK if salt else LONG_LIST))
            if long.take(1):
                found = stored(found.unionByName(self.inside_lists(long, salt)), "join-links")
                lists = self.parted(lists.drop("part"), found)
        short = lists.filter(F.col("size") <= LONG_LIST)
        found = found.unionByName(self.verified(stored(self.inside_short(short).distinct(), "join-short")))
        long = lists.filter(F.col("size") > LONG_LIST)
        return found.unionByName(self.across_lists(long)) if long.take(1) else found

    def across_lists(self, long: DataFrame) -> DataFrame:
        """Links between the parts of long lists.

        Every node outside the largest part of its list is compared with all nodes of the
        list: blocks of nodes against chunks of these outsiders, inside tasks. Lists that
        share nodes are a family. Where its lists overlap much, the family is dealt as one
        list, so that a pair that meets in many of them is looked at once.
        """
        chain = long.filter("before IS NOT NULL").select(F.col("before").alias("u"), F.col("node").alias("v")).distinct()
        family = connected_components(chain).withColumnRenamed("component_id", "family")
        member = stored(long.select("sig", "node", "part", "n").join(family, "node"), "join-family")
        listed = member.select(F.xxhash64(F.lit("list"), "sig").alias("a"), "family", "node", "part", "n")
        whole = member.select(F.xxhash64(F.lit("family"), "family").alias("a"), "family", "node", "part", "n").distinct()
        plans = stored(self.dealing(listed).withColumn("whole", F.lit(False)).unionByName(self.dealing(whole).withColumn("whole", F.lit(True))), "join-plans")
        rows = lambda at: F.coalesce(F.sum(F.when(at, F.col("rows"))), F.lit(0))
        cheap = plans.groupBy("family").agg((rows(F.col("whole")) <= rows(~F.col("whole"))).alias("whole"))
        plan = stored(plans.join(cheap, ["family", "whole"]).select("a", "main", "blocks", "chunks", "rows"), "join-plan")
        dealt = stored(listed.unionByName(whole).join(plan, "a").withColumn("h", F.xxhash64("node")), "join-dealt")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = dealt.select("a", F.pmod("h", "blocks").alias("b"), upto("chunks").alias("c"), F.lit(0).alias("side"), "node", "part")
        outside = dealt.filter("part <> main").select("a", upto("blocks").alias("b"), F.pmod("h", "chunks").alias("c"), F.lit(1).alias("side"), "node", "part")
        return self.in_blocks(own.unionByName(outside), plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])

    def dealing(self, listed: DataFrame) -> DataFrame:
        """``family, a, main, blocks, chunks, rows`` of each list ``a``: how it is dealt, and the rows that this makes."""
        blocks = lambda rows, tokens: F.greatest(F.lit(1), F.ceil(F.greatest(rows / BLOCK, tokens / BLOCK_SHINGLES))).cast("long")
        share = listed.groupBy("family", "a", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
        total = share.groupBy("family", "a").agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.max(F.struct("rows", "part", "tokens")).alias("top"))
        outside, tokens = F.col("rows") - F.col("top.rows"), F.col("tokens") - F.col("top.tokens")
        planned = total.select("family", "a", F.col("top.part").alias("main"), blocks(F.col("rows"), F.col("tokens")).alias("blocks"), blocks(outside, tokens).alias("chunks"), "rows", outside.alias("outside"))
        return planned.filter("outside > 0").select("family", "a", "main", "blocks", "chunks", F.expr("rows * chunks + outside * blocks").alias("rows"))

    def groups(self) -> DataFrame:
        """``doc_id, doc, stamp, n, node, root``: root names the group; null for empty sets."""
        with scratch(self.rows.sparkSession):
            parts = stored(connected_components(self.links()).select("node", F.col("component_id").alias("root")), "join-components", keep=True)
        return self.sets.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document."""
    grouped = stored(_Join(docs, percent).groups(), "join-groups")
    # stored, so that the join's two sides are plain shuffles and a large group can be split
    least = stored(grouped.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "join-least")
    return grouped.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns: of each group the row with the smallest id, and all empty ones."""
    grouped = _Join(docs, percent).groups()
    stay = grouped.groupBy(F.coalesce("root", "stamp").alias("root"), F.col("root").isNull().alias("empty")).agg(F.min(F.struct("doc", "stamp")).alias("r"))
    keep = stored(stay.select(F.col("r.doc").alias("__doc"), F.col("r.stamp").alias("__stamp"), F.col("empty").alias("__empty")), "join-stay")
    rows = docs.withColumn("__doc", doc_key()).withColumn("__stamp", doc_stamp())
    thin, maybe = marked(rows, "__stamp", keep, "__stamp")
    kept = thin.filter(maybe).join(keep, ["__doc", "__stamp"])
    full = kept.filter("NOT __empty").dropDuplicates(["__doc", "__stamp"])
    return full.unionByName(kept.filter("__empty")).select(*[F.col(f"`{c}`") for c in docs.columns])
