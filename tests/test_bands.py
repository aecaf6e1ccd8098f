"""Band operators against NumPy, over several band heights, pieces and tile shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import bands, pixels, stitch

RNG = np.random.default_rng(11)
MAPS = {1: RNG.normal(size=(13, 9)), 2: RNG.normal(size=(1, 1)), 3: RNG.normal(size=(7, 21)), 4: RNG.normal(size=(2, 3))}


def arrays(spark):
    rows = [(k, m.shape[1], m.shape[0], m.ravel().tolist()) for k, m in MAPS.items()]
    return spark.createDataFrame(rows, "image long, width int, height int, values array<double>")


def cells(spark):
    rows = [(k, y, x, float(v)) for k, m in MAPS.items() for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "image long, y int, x int, v double").repartition(3)


def gathered(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.image, {})[r.y] = r.row
    return {k: np.array([v[y] for y in range(len(v))]) for k, v in out.items()}


def line(m, n, aligned, axis):
    size = m.shape[axis]
    at = np.arange(n) * (size - 1) / max(n - 1, 1) if aligned else np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, size - 1)
    part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return m.take(low, axis) * (1 - part) + m.take(high, axis) * part


@pytest.mark.parametrize("band", [1, 3, 64])
@pytest.mark.parametrize("aligned", [False, True])
def test_resize_equals_numpy(spark, band, aligned):
    got = gathered(bands.resize(bands.from_arrays(arrays(spark), band, 1), 6, 10, aligned, band))
    assert got.keys() == MAPS.keys()
    for k, m in MAPS.items():
        assert np.allclose(got[k], line(line(m, 10, aligned, 0), 6, aligned, 1), atol=1e-12)


def smoothed(m, sigma):
    for axis in (0, 1):
        n = m.shape[axis]
        at = np.arange(n)
        out = 0
        for k, w in bands.kernel(sigma):
            period = (at + k) % (2 * n)
            out = out + w * m.take(np.minimum(period, 2 * n - 1 - period), axis)
        m = out
    return m


@pytest.mark.parametrize("band", [2, 5, 64])
def test_smoothing_equals_numpy(spark, band):
    halo = len(bands.kernel(0.8)) // 2
    got = gathered(bands.smooth(bands.from_arrays(arrays(spark), band, halo), 0.8, band))
    assert all(np.allclose(got[k], smoothed(m, 0.8), atol=1e-12) for k, m in MAPS.items()) and got.keys() == MAPS.keys()


@pytest.mark.parametrize(("band", "halo"), [(1, 0), (3, 1), (2, 5), (64, 4)])
def test_cells_and_arrays_give_the_same_bands(spark, band, halo):
    sizes = arrays(spark).drop("values")
    key = lambda r: (r.image, r.band, r.y0, r.width, r.height, r.rows)
    a = sorted(map(key, bands.from_arrays(arrays(spark), band, halo).collect()))
    assert a == sorted(map(key, bands.from_cells(cells(spark), sizes, band, halo).collect()))
    back = gathered(bands.rows_of(bands.from_cells(cells(spark), sizes, band, halo), band))
    assert all((back[k] == m).all() for k, m in MAPS.items())


def test_incomplete_maps_fail(spark):
    sizes = arrays(spark).drop("values")
    for gap in ("NOT (image = 1 AND y = 4 AND x = 2)", "NOT (image = 3 AND y = 6)"):
        with pytest.raises(Exception, match="a map lacks"):
            bands.from_cells(cells(spark).filter(gap), sizes).collect()
    with pytest.raises(Exception, match="width"):
        bands.from_arrays(arrays(spark).withColumn("width", F.col("width") + 1)).collect()


def test_pixel_interface(spark):
    sizes = arrays(spark).drop("values")
    up = {(r.image, r.y, r.x): r.v for r in pixels.resize_bilinear(cells(spark), sizes, 6, 10).collect()}
    want = line(line(MAPS[1], 10, False, 0), 6, False, 1)
    assert len(up) == 240 and all(abs(up[1, y, x] - v) < 1e-12 for (y, x), v in np.ndenumerate(want))
    soft = {(r.image, r.y, r.x): r.v for r in pixels.gaussian_smooth(cells(spark), sizes, 1.2).collect()}
    assert all(abs(soft[3, y, x] - v) < 1e-12 for (y, x), v in np.ndenumerate(smoothed(MAPS[3], 1.2)))


def tiles_of(pw, ph, sw, sh):
    """Tiles by stride, some of them over the edge."""
    return [(k, 100 * j + i, x, y, m.shape[1], m.shape[0], min(pw, m.shape[1] - x), min(ph, m.shape[0] - y), pw, ph) for k, m in MAPS.items() for j, y in enumerate(range(0, m.shape[0], sh)) for i, x in enumerate(range(0, m.shape[1], sw))]


TILES = "image long, tile_id int, x int, y int, width int, height int, valid_w int, valid_h int, pw int, ph int"


@pytest.mark.parametrize("band", [1, 4, 64])
def test_tiles_need_not_be_square(spark, band):
    tiles = tiles_of(5, 3, 4, 2)
    t = spark.createDataFrame(tiles, TILES)
    b = bands.from_arrays(arrays(spark), band, 0)
    for edge, mode in (("replicate", {"mode": "edge"}), ("zero", {"mode": "constant"})):
        got = {}
        for r in bands.tile_rows(t, b, 5, 3, edge, band).collect():
            got.setdefault((r.image, r.tile_id), {})[r.ty] = r.row
        assert len(got) == len(tiles)
        for k, tile, x, y, *_ in tiles:
            want = np.pad(MAPS[k], ((0, 3), (0, 5)), **mode)[y : y + 3, x : x + 5]
            assert (np.array([got[k, tile][ty] for ty in range(3)]) == want).all()
    flat = stitch.tile_cells(t, cells(spark), 5, 3).filter("image = 3 AND tile_id = 305").collect()
    assert len(flat) == 15


def hann(n):
    return np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


@pytest.mark.parametrize("piece", [3, 8, 256])
def test_overlap_add_of_two_tile_sizes(spark, piece):
    """Tiles of two shapes add up, each with weights of its own size."""
    tiles = [*tiles_of(5, 3, 4, 2), *[(k, 9000 + t, *r) for k, t, *r in tiles_of(4, 4, 4, 4)]]
    rng = np.random.default_rng(12)
    total = {k: np.zeros((2, *m.shape)) for k, m in MAPS.items()}
    rows, flat = [], []
    for k, _, x, y, _, _, vw, vh, pw, ph in tiles:
        v = rng.normal(size=(ph, pw))
        w = 0.05 + 0.95 * np.outer(hann(ph), hann(pw))
        total[k][0, y : y + vh, x : x + vw] += (v * w)[:vh, :vw]
        total[k][1, y : y + vh, x : x + vw] += w[:vh, :vw]
        rows += [(k, x, y, vw, vh, ty, v[ty].tolist(), pw, ph) for ty in range(ph)]
        flat += [(k, x, y, vw, vh, ty, tx, float(v[ty, tx]), pw, ph) for ty in range(ph) for tx in range(pw)]
    d = spark.createDataFrame(rows, "image long, x int, y int, valid_w int, valid_h int, ty int, row array<double>, pw int, ph int")
    got = {(r.image, r.y, r.x): r.v for r in bands.stitched_cells(bands.overlap_add(d, F.col("pw"), F.col("ph"), piece)).collect()}
    old = {(r.image, r.y, r.x): r.v for r in stitch.overlap_add(spark.createDataFrame(flat, "image long, x int, y int, valid_w int, valid_h int, ty int, tx int, v double, pw int, ph int"), "pw", "ph").collect()}
    assert got.keys() == old.keys()
    for k, (s, w) in total.items():
        for (y, x), v in np.ndenumerate(s / w):
            assert abs(got[k, y, x] - v) < 1e-5 and abs(old[k, y, x] - v) < 1e-5


def test_plans_have_no_shuffle_by_pixel(spark):
    b = bands.from_arrays(arrays(spark))
    for rows in (bands.resize(b, 6, 10), bands.smooth(bands.from_arrays(arrays(spark), halo=4), 1.0)):
        assert "Exchange" not in bands.cells_of(rows)._jdf.queryExecution().executedPlan().toString()
