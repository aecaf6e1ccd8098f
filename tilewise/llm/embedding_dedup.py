"""Near-duplicate vectors by lattice hashing.

Each table projects the vectors at random to two blocks of eight dimensions and decodes
each block to its nearest point of the E8 lattice; the two points and the label name a
cell. Every vector is indexed in its own cell and probes cells next to it: the other
near lattice points of each block. Vectors that meet are verified by cosine in double
precision, so a link is never wrong; the tables and probes set the share of links found.

Equal vectors of a label are one class: it is indexed once and its members count as
linked with each other, whatever their number.

Defined cases: rows with a null label, a null or zero vector, or one with null or
non-finite components link with nothing and are their own component; rows that repeat
a vec_id share the id's links; vectors of other lengths than their partner's don't
link; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm.components import connected_components
from tilewise.llm.shared import pick, stored
from tilewise.llm.textkernel import splitmix

TABLES = 6
#: Lattice units per unit of projected length.
SCALE = 2.0
#: Cells that a vector probes besides its own, in each table.
PROBES = 5
BLOCKS = 2
SEED = 11


@lru_cache(maxsize=16)
def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    """tables x BLOCKS matrices with (dim, 8) random Gaussian columns."""
    rng = np.random.default_rng((seed, dim))
    return rng.standard_normal((tables, BLOCKS, dim, 8)) / np.sqrt(8.0)


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest point of the even-sum integer lattice."""
    r = np.rint(x)
    err = x - r
    order = np.argsort(-np.abs(err), axis=1)
    rows = np.arange(len(x))
    step = np.where(err < 0, -1.0, 1.0)

    def flipped(p: np.ndarray, k: int) -> np.ndarray:
        q = p.copy()
        at = order[:, k]
        q[rows, at] += step[rows, at]
        return q

    odd = (r.sum(axis=1) % 2 != 0)[:, None]
    one, two = flipped(r, 0), flipped(r, 1)
    return np.where(odd, one, r), np.where(odd, two, flipped(one, 1))


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three nearest candidates of each row, nearest first: (points doubled, squared distances)."""
    a, a2 = _d8(x)
    b, b2 = _d8(x - 0.5)
    points = np.stack([a, a2, b + 0.5, b2 + 0.5], axis=1)
    dist = ((points - x[:, None, :]) ** 2).sum(axis=2)
    order = np.argsort(dist, axis=1, kind="stable")[:, :3]
    return np.take_along_axis(2 * points, order[:, :, None], axis=1).astype(np.int64), np.take_along_axis(dist, order, axis=1)


def _cell(points: np.ndarray) -> np.ndarray:
    h = np.zeros(points.shape[:-1], np.uint64)
    for k in range(points.shape[-1]):
        h = splitmix(h + points[..., k].astype(np.uint64) + np.uint64(k + 1))
    return h


def cells(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes) cell hashes; the first is the vector's own."""
    out = np.zeros((len(unit), tables, 1 + probes), np.uint64)
    m = projections(unit.shape[1], tables, seed)
    for t in range(tables):
        keys, dist = [], []
        for block in range(BLOCKS):
            p, d = e8(unit @ m[t, block] * scale)
            keys.append(_cell(p))
            dist.append(d)
        both = splitmix(keys[0][:, :, None] * np.uint64(3) + keys[1][:, None, :] + np.uint64(t)).reshape(len(unit), -1)
        cost = (dist[0][:, :, None] + dist[1][:, None, :]).reshape(len(unit), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = np.take_along_axis(both, order, axis=1)
    return out


def _indexed(batches: Iterator[pa.RecordBatch], tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = b.column(2).to_pylist()
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            x = np.array([vectors[i] for i in at], np.float64)
            found = cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables, SCALE, probes)
            n = len(at) * tables * (1 + probes)
            rep = np.repeat(np.array(b.column(0))[at], tables * (1 + probes))
            label = np.repeat(np.array(b.column(1))[at], tables * (1 + probes))
            own = np.tile(np.arange(1 + probes) == 0, n // (1 + probes))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(label), pa.array(found.reshape(-1).astype(np.int64)), pa.array(own)], ["rep", "label", "cell", "own"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
        keep = np.zeros(b.num_rows, bool)
        same = np.array([len(x) == len(y) for x, y in zip(left, right, strict=True)], bool)
        at = np.nonzero(same)[0]
        for size in {len(left[i]) for i in at}:
            rows = np.array([i for i in at if len(left[i]) == size])
            x, y = np.array([left[i] for i in rows], np.float64), np.array([right[i] for i in rows], np.float64)
            keep[rows] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= least
        kept = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], ["u", "v"])


def links(classes: DataFrame, least: float, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``u, v`` (u < v) of the class representatives that reach the cosine."""
    rows = stored(classes.select("rep", "label", "vector").mapInArrow(partial(_indexed, tables=tables, probes=probes), "rep long, label int, cell long, own boolean"), "lattice-cells")
    own = rows.filter("own").select(F.col("rep").alias("a"), "label", "cell")
    probing = rows.select(F.col("rep").alias("b"), "label", "cell")
    met = own.join(probing, ["label", "cell"]).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    x = classes.select(F.col("rep").alias("u"), F.col("vector").alias("x"))
    y = classes.select(F.col("rep").alias("v"), F.col("vector").alias("y"))
    return met.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(partial(_verified, least=least), "u long, v long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each vector."""
    rows = pick(vectors, "vec_id", "embedding", "label")
    # a null component fails isfinite's comparison, a zero vector the sum of squares
    sound = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & (F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0),
        F.lit(False),
    )
    usable = rows.filter(sound).select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    keyed = usable.withColumn("key", F.sha2(F.to_json("vector"), 256))
    classes = stored(keyed.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("vector").alias("vector")), "vector-classes")
    # an id that stands for several classes keeps one class number each
    numbered = stored(classes.withColumn("id", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()), "vector-numbered")
    members = keyed.join(numbered.select("label", "key", "rep"), ["label", "key"]).select("vec_id", "rep")
    linked = stored(links(numbered, least, tables, probes), "vector-links")
    size = numbered.select("rep", "n")
    ends = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = ends.join(size.withColumnRenamed("rep", "v"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    of = size.join(degree, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    parts = connected_components(linked)
    named = (
        numbered.select("rep", "id").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component_id", "rep"))
    )
    least_id = named.groupBy("part").agg(F.min("id").alias("component"))
    found = members.join(of, "rep").join(named.select("rep", "part").join(least_id, "part").select("rep", "component"), "rep")
    per_id = found.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("vec_id", sound.alias("sound")).join(per_id, "vec_id", "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
