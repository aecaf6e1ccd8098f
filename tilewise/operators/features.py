"""Token evidence: distance of encoder and decoder features, and its reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.functions.vectors import cosine_distance, dot, is_finite
from tilewise.operators import bands
from tilewise.operators.ranks import running
from tilewise.operators.sampling import fair_sample
from tilewise.sources.storage import stored


def token_distance(tokens: DataFrame) -> DataFrame:
    """Adds ``distance`` of ``enc`` and ``dec`` to token rows."""
    return tokens.withColumn("distance", cosine_distance(F.col("enc"), F.col("dec")))


def token_max(distances: DataFrame, keys: list[str]) -> DataFrame:
    """The largest distance over layers of each token."""
    return distances.groupBy(*keys).agg(F.max("distance").alias("distance"))


def top_k_mean(distances: DataFrame, keys: list[str], k: int, order: str = "token") -> DataFrame:
    """Mean of the k largest distances of each tile (all, if it has fewer)."""
    if k < 1:
        raise ValueError("k must be positive")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("distance"), order))
    return distances.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy(*keys).agg(F.avg("distance").alias("score"))


def image_scores(tile_scores: DataFrame, keys: list[str]) -> DataFrame:
    """The largest tile or thumbnail score of each image, as a 32-bit float.

    A score that is null, NaN or infinite fails the job: it would win or vanish silently.
    """
    sound = F.when(F.col("score").isNotNull() & is_finite(F.col("score")), F.col("score")).otherwise(F.raise_error(F.lit("a tile score is not finite")).cast("double"))
    return tile_scores.groupBy(*keys).agg(F.max(sound).cast("float").alias("score"))


def not_finite(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose number is null, NaN or infinite: a contract violation."""
    return rows.filter(F.col(column).isNull() | ~is_finite(F.col(column)))


def fit_centroids(tokens: DataFrame, keys: tuple[str, ...] = ("clsname", "token"), weight: str | None = None) -> DataFrame:
    """Mean feature vector of the normal tokens of each category and place, weighed if asked.

    Summed per dimension with partial aggregation: nothing but sums is shuffled.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    dims = tokens.filter("normal").select(*keys, w.alias("w"), F.posexplode("enc").alias("dim", "v"))
    means = dims.groupBy(*keys, "dim").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.sum("w")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("dec"))


def fit_reweighted(tokens: DataFrame, rounds: int, per_epoch: int, share: float, factor: float, source: str = "image", place: str = "token") -> DataFrame:
    """Centroids of a training run: each round fits its source-fair sample of the normal tokens,
    the easiest of them (by their distance to the round before) with weight ``factor``.

    The share of easy tokens rises from 0 in the first round to ``share`` in the last. Every
    round's model is a written table, so a lost executor repeats one round, not all.
    """
    normals = tokens.filter("normal")
    model = None
    for epoch in range(rounds):
        sample = fair_sample(normals, source, place, per_epoch, epoch)
        if model is not None:
            met = token_distance(reconstruct_centroid(sample, model)).withColumn("distance", F.round("distance", 6)).drop("dec")
            sample = hard_mining_weights(met, ["clsname", "token"], [source], ramped_share(epoch, rounds - 1, share), factor)
        model = stored(fit_centroids(sample, weight=None if model is None else "weight"), "centroids")
    return model


def reconstruct_centroid(tokens: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = ("clsname", "token")) -> DataFrame:
    """Adds ``dec``; a category without normals has none and its tokens are left out."""
    return tokens.join(centroids, list(keys))


GRAM = "clsname {kind}, place int, total double"


def _gram_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed upper triangles of the products of a batch's centred vectors, by category."""
    for b in batches:
        names = b.column(0).dictionary_encode()
        if not b.num_rows:
            continue
        rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        upper = np.triu_indices(rows.shape[1])
        of = names.indices.to_numpy(zero_copy_only=False)
        packed = [(rows[of == k].T @ rows[of == k])[upper] for k in range(len(names.dictionary))]
        n = len(upper[0])
        category = names.dictionary.take(pa.array(np.repeat(np.arange(len(packed)), n)))
        yield pa.RecordBatch.from_arrays([category, pa.array(np.tile(np.arange(n, dtype=np.int32), len(packed))), pa.array(np.concatenate(packed))], ["clsname", "place", "total"])


def _principal(table: pa.Table, rank: int) -> pa.Table:
    """The leading eigenvectors of one category's products, the largest entry of each positive."""
    packed = table.sort_by("place").column("total").to_numpy()
    dims = int(((8 * len(packed) + 1) ** 0.5 - 1) / 2)
    gram = np.zeros((dims, dims))
    gram[np.triu_indices(dims)] = packed
    gram += np.triu(gram, 1).T
    _, vectors = np.linalg.eigh(gram)
    basis = vectors[:, ::-1][:, : min(rank, dims)]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return pa.table({"clsname": table.column("clsname").slice(0, 1), "basis": pa.array([basis.T.tolist()], pa.list_(pa.list_(pa.float64())))})


def fit_low_rank(tokens: DataFrame, means: DataFrame, rank: int) -> DataFrame:
    """``clsname, basis``: the ``rank`` leading components of the centred normal tokens of each category.

    Products are summed inside batches and then over them, so dims * (dims + 1) / 2 numbers for
    each category and batch are shuffled, whatever the number of tokens.
    """
    if rank < 1:
        raise ValueError("the rank must be positive")
    kind = tokens.schema["clsname"].dataType.simpleString()
    normals = centred(tokens, means).filter("normal").select("clsname", "centred")
    sums = normals.mapInArrow(_gram_parts, GRAM.format(kind=kind)).groupBy("clsname", "place").agg(F.sum("total").alias("total"))
    return sums.groupBy("clsname").applyInArrow(lambda t: _principal(t, rank), f"clsname {kind}, basis array<array<double>>")


def centred(tokens: DataFrame, means: DataFrame) -> DataFrame:
    """Adds ``mean`` and ``centred``: the token less the mean of its category and place."""
    joined = reconstruct_centroid(tokens, means).withColumnRenamed("dec", "mean")
    return joined.withColumn("centred", F.zip_with("enc", "mean", lambda a, b: a.cast("double") - b))


def reconstruct_low_rank(tokens: DataFrame, rank: int) -> DataFrame:
    """Adds ``dec``: each token rebuilt from ``rank`` components fitted on its category's normal tokens."""
    means = fit_centroids(tokens)
    return apply_low_rank(tokens, means, fit_low_rank(tokens, means, rank))


def apply_low_rank(tokens: DataFrame, means: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``dec``: the mean, and the part of the centred token that lies in its category's components."""
    joined = centred(tokens, means).join(model, "clsname")
    coded = joined.withColumn("code", F.transform("basis", lambda b: dot(b, F.col("centred"))))
    part = lambda d: F.aggregate(F.zip_with("code", "basis", lambda c, b: c * F.element_at(b, d + 1)), F.lit(0.0), lambda s, v: s + v)
    return coded.withColumn("dec", F.transform("mean", lambda m, d: m + part(d))).drop("mean", "centred", "code", "basis")


def layer_mean(tokens: DataFrame, keys: list[str], column: str = "enc") -> DataFrame:
    """Mean feature vector over a group of layers (or any other grouping)."""
    dims = tokens.select(*keys, F.posexplode(column).alias("dim", "v"))
    means = dims.groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def fuse_resolutions(contexts: DataFrame, keys: list[str], weights: dict[int, float]) -> DataFrame:
    """Weighted sum over scales of features already cropped and resized to the main grid.

    ``contexts``: keys, ``scale`` and ``feature``; weights are normalised to sum 1.
    """
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    total = sum(weights.values())
    w = F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(v / total))])
    dims = contexts.select(*keys, w[F.col("scale")].alias("w"), F.posexplode("feature").alias("dim", "v"))
    sums = dims.groupBy(*keys, "dim").agg(F.sum(F.col("v").cast("double") * F.col("w")).alias("m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("fused"))


def fuse_contexts(main: DataFrame, contexts: DataFrame, weights: dict[int, float], patch_w: int, patch_h: int) -> DataFrame:
    """``image, tile_id, channel, width, height, fused``: feature grids of tiles with those around them.

    ``main``: ``image, tile_id, channel, width, height, values``; ``contexts``: the same of the
    enclosing tile of each scale, with ``context_scale`` and where the main tile lies in it
    (``ix, iy, iw, ih`` in model pixels). That part of the context's grid is cropped, resampled
    to the main grid and added with the scale's weight (scale 0 is the main grid; weights are
    normalised to sum 1). A tile without one of the scales, or whose part holds no cell, fails.
    """
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    share = F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(v / sum(weights.values())))])
    keys = ["image", "tile_id", "channel"]
    # from model pixels to cells of the context's grid, cut towards 0
    cell = lambda at, size, patch: F.floor(at * F.col(size) / patch).cast("int")
    x, y = F.col("ix"), F.col("iy")
    cut = contexts.withColumns({"x0": cell(x, "width", patch_w), "x1": cell(x + F.col("iw"), "width", patch_w), "y0": cell(y, "height", patch_h), "y1": cell(y + F.col("ih"), "height", patch_h)})
    held = F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.col("values")).otherwise(F.raise_error(F.lit("a tile covers no cell of its context")).cast("array<double>"))
    part = bands.crop_values(held, F.col("width"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    parts = cut.select(*keys, F.col("context_scale").alias("scale"), (F.col("x1") - F.col("x0")).alias("pw"), (F.col("y1") - F.col("y0")).alias("ph"), part.alias("part"))
    size = main.select(*keys, "width", "height")
    resized = parts.join(size, keys).select(*keys, "scale", "width", "height", bands.resize_values(F.col("part"), F.col("pw"), F.col("ph"), F.col("width"), F.col("height")).alias("values"))
    every = main.select(*keys, F.lit(0).alias("scale"), "width", "height", F.col("values").cast("array<double>").alias("values")).unionByName(resized)
    weighed = every.select(*keys, "width", "height", F.struct("scale", F.transform("values", lambda v: v * share[F.col("scale")]).alias("values")).alias("s"))
    # one element for each scale
    met = weighed.groupBy(*keys, "width", "height").agg(F.array_sort(F.collect_list("s")).alias("s"))
    whole = F.when(F.transform("s", lambda s: s["scale"]) == F.array(*[F.lit(s) for s in sorted(weights)]), F.col("s")).otherwise(F.raise_error(F.lit("a tile lacks a scale")).cast(met.schema["s"].dataType))
    none = F.array_repeat(F.lit(0.0), F.col("width") * F.col("height"))
    return met.select(*keys, "width", "height", F.aggregate(whole, none, lambda acc, s: F.zip_with(acc, s["values"], lambda a, b: a + b)).alias("fused"))


def reconstruction_loss(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """1 - cosine of all token features of an image taken as one vector."""
    parts = tokens.select(*keys, dot(F.col("enc"), F.col("dec")).alias("ab"), dot(F.col("enc"), F.col("enc")).alias("aa"), dot(F.col("dec"), F.col("dec")).alias("bb"))
    return parts.groupBy(*keys).agg((1 - F.sum("ab") / (F.sqrt(F.sum("aa")) * F.sqrt(F.sum("bb")))).alias("loss"))


def hard_mining_weights(distances: DataFrame, keys: list[str], order: list[str], share: float, factor: float) -> DataFrame:
    """Adds ``weight``: ``factor`` for the easiest int(n * share) tokens of a layer, else 1.

    Places are counted over ranges of distances, so a layer may have any number of tokens.
    """
    placed = running(distances.withColumn("one", F.lit(1)), keys, ["distance", *order], ["one"])
    return placed.withColumn("weight", F.when(F.col("up_to_one") <= F.floor(F.col("all_one") * share), factor).otherwise(1.0)).drop("one", "up_to_one", "all_one")


def ramped_share(step: int, warm_up: int, final: float) -> float:
    """Share of easy tokens at a training step: linear up to ``final``."""
    return final * min(1.0, step / warm_up) if warm_up > 0 else final


def score_tiles(tiles: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Batch scoring by a user's model: tile rows in, token rows out, one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return tiles.mapInPandas(run, schema)
