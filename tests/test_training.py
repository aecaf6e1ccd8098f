"""Low-rank models, re-weighted fits and context fusion against NumPy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from tilewise.operators import bands, features
from tilewise.plans import catalog, evidence
from tilewise.sources import tables

TOKENS = "image long, clsname string, normal boolean, token int, enc array<float>"


def cosine(a, b):
    norm = lambda v: max(np.sqrt((v * v).sum()), 1e-8)
    return min(max(1 - (a * b).sum() / (norm(a) * norm(b)), 0), 2)


def rebuilt(rows, rank):
    """Each token from the leading components of its category's centred normal tokens."""
    mean = {k: np.mean([r.enc for r in rows if r.normal and (r.clsname, r.token) == k], axis=0) for k in {(r.clsname, r.token) for r in rows if r.normal}}
    out = {}
    for c in {k[0] for k in mean}:
        x = np.array([np.array(r.enc) - mean[c, r.token] for r in rows if r.normal and r.clsname == c])
        basis = np.linalg.svd(x, full_matrices=False)[2][:rank]
        for r in rows:
            if r.clsname == c and (c, r.token) in mean:
                m = mean[c, r.token]
                out[r.image, r.token] = m + basis.T @ (basis @ (np.array(r.enc) - m))
    return out


@pytest.mark.parametrize("rank", [1, 3, 99])
def test_low_rank_equals_numpy(spark, rank):
    tokens = tables.encoder_tokens(spark, DATA)
    want = rebuilt(tokens.collect(), rank)
    got = features.reconstruct_low_rank(tokens.repartition(5), rank).collect()
    assert len(got) == len(want)
    assert all(np.allclose(r.dec, want[r.image, r.token], atol=1e-6) for r in got)


def test_low_rank_detector_equals_numpy(spark):
    rows = tables.encoder_tokens(spark, DATA).collect()
    dec = rebuilt(rows, evidence.RANK)
    far = {}
    for r in rows:
        if (r.image, r.token) in dec:
            far.setdefault(r.image, []).append(cosine(np.array(r.enc, float), dec[r.image, r.token]))
    got = {r.image: r.score for r in catalog.QUERIES["low_rank_detector"](spark, DATA).collect()}
    assert got.keys() == far.keys()
    assert all(abs(got[i] - np.mean(sorted(d)[-evidence.TOP_K :])) < 2e-6 for i, d in far.items())


def test_low_rank_edges(spark):
    rows = [(1, "a", True, 0, [1.0, 2.0]), (2, "a", False, 0, [3.0, 1.0]), (3, "b", False, 0, [1.0, 1.0])]
    got = features.reconstruct_low_rank(spark.createDataFrame(rows, TOKENS), 1).collect()
    assert {r.image for r in got} == {1, 2}  # a category without normals has no model
    assert [r.dec for r in got if r.image == 1] == [[1.0, 2.0]]
    with pytest.raises(ValueError, match="rank"):
        features.fit_low_rank(spark.createDataFrame(rows, TOKENS), None, 0)


def test_reweighted_fit_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], bool(i % 5), t, rng.normal(size=3).round(3).tolist()) for i in range(60) for t in range(4)]
    model = features.fit_reweighted(spark.createDataFrame(rows, TOKENS).repartition(3), 3, 2, 0.5, 0.25)
    got = {(r.clsname, r.token): r.dec for r in model.collect()}
    want = None
    for epoch in range(3):
        taken = []
        for i in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == i and r[2]), key=lambda r: hashlib.md5(f"s:{i}:{r[3]}".encode()).hexdigest())
            taken += [r for p, r in enumerate(own) if (p - epoch * 2) % len(own) < min(2, len(own))]
        share, new = 0.5 * epoch / 2, {}
        for k in {(r[1], r[3]) for r in taken}:
            own = [r for r in taken if (r[1], r[3]) == k]
            enc = np.array([np.float32(r[4]) for r in own], float)
            weight = np.ones(len(own))
            if want is not None:
                order = sorted(range(len(own)), key=lambda j: (round(cosine(enc[j], want[k]), 6), own[j][0]))
                weight[order[: int(len(own) * share)]] = 0.25
            new[k] = (weight[:, None] * enc).sum(0) / weight.sum()
        want = new
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def grid_resize(m, h, w):
    for axis, n in ((0, h), (1, w)):
        size = m.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        m = m.take(low, axis) * (1 - part) + m.take(np.minimum(low + 1, size - 1), axis) * part
    return m


MAIN = "image long, tile_id int, channel int, width int, height int, values array<double>"
AROUND = f"{MAIN}, context_scale int, ix int, iy int, iw int, ih int"


def test_fusion_of_grids_with_channels(spark):
    """Grids and patches that are not square, two channels, two scales."""
    rng = np.random.default_rng(4)
    main, around, want = [], [], {}
    for image in range(3):
        for tile in range(2):
            for channel in range(2):
                own = rng.normal(size=(3, 5))
                main.append((image, tile, channel, 5, 3, own.ravel().tolist()))
                total = 0.5 * own
                for scale, (ix, iy, iw, ih) in ((1, (20 * tile, 16, 20, 16)), (3, (5, 7, 11, 9))):
                    m = rng.normal(size=(8, 10))
                    around.append((image, tile, channel, 10, 8, m.ravel().tolist(), scale, ix, iy, iw, ih))
                    # a patch of 40 x 32 model pixels: cells of 4 x 4
                    cut = m[iy // 4 : (iy + ih) // 4, ix // 4 : (ix + iw) // 4]
                    total = total + {1: 0.375, 3: 0.125}[scale] * grid_resize(cut, 3, 5)
                want[image, tile, channel] = total
    m, c = spark.createDataFrame(main, MAIN), spark.createDataFrame(around, AROUND)
    got = {(r.image, r.tile_id, r.channel): r for r in features.fuse_contexts(m, c, {0: 4.0, 1: 3.0, 3: 1.0}, 40, 32).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(np.reshape(got[k].fused, (3, 5)), v, atol=1e-12) for k, v in want.items())
    alone = features.fuse_contexts(m, c.limit(0), {0: 2.0}, 40, 32).collect()
    assert all(np.allclose(r.fused, next(x[5] for x in main if x[:3] == (r.image, r.tile_id, r.channel))) for r in alone)
    with pytest.raises(Exception, match="lacks a scale"):
        features.fuse_contexts(m, c.filter("NOT (image = 1 AND context_scale = 3)"), {0: 4.0, 1: 3.0, 3: 1.0}, 40, 32).collect()
    with pytest.raises(Exception, match="no cell"):
        features.fuse_contexts(m, c.withColumn("iw", F.lit(0)), {0: 4.0, 1: 3.0, 3: 1.0}, 40, 32).collect()
    with pytest.raises(ValueError, match="weights"):
        features.fuse_contexts(m, c, {0: 0.0}, 40, 32)


def test_array_maps_resize_like_bands(spark):
    m = np.random.default_rng(5).normal(size=(4, 7))
    d = spark.createDataFrame([(1, 7, 4, m.ravel().tolist())], "image long, width int, height int, values array<double>")
    out = d.select(bands.resize_values(F.col("values"), F.col("width"), F.col("height"), 9, 6).alias("v")).first().v
    assert np.allclose(np.reshape(out, (6, 9)), grid_resize(m, 6, 9), atol=1e-12)
