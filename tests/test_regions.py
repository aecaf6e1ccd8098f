"""Regions by bands against a flood fill."""

import numpy as np
import pytest

from tilewise.operators import regions


def flooded(masks):
    """(image, y, x) -> smallest run (y << 31 | x0) of the 4-neighbour region."""
    out = {}
    for image, m in masks.items():
        seen = np.zeros(m.shape, bool)
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            todo, region = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                region.append((a, b))
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
            a, b = min(region)  # the first pixel of the first run
            out |= {(image, int(c), int(d)): int(a) << 31 | int(b) for c, d in region}
    return out


def spiral(n):
    """One path from the edge to the middle, a pixel wide with a gap of one."""
    m = np.zeros((n, n), bool)
    top, left, bottom, right = 0, 0, n - 1, n - 1
    m[0, :] = True
    while top <= bottom and left <= right:
        m[top : bottom + 1, right] = True
        m[bottom, left : right + 1] = True
        m[top + 2 : bottom + 1, left] = True
        if top + 2 <= bottom:
            m[top + 2, left : right - 1] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return m


def masks():
    rng = np.random.default_rng(6)
    out = {f"noise {k}": rng.random((17, 23)) < d for k, d in enumerate((0.2, 0.5, 0.6, 0.75))}
    ladder = np.zeros((31, 9), bool)
    ladder[:, 0] = ladder[:, 8] = ladder[::3] = True
    comb = np.zeros((33, 21), bool)
    comb[:, ::2] = comb[32] = True  # teeth that meet in the last row only
    return out | {"spiral": spiral(41), "ladder": ladder, "comb": comb, "all": np.ones((20, 5), bool), "none": np.zeros((6, 6), bool), "dot": np.eye(12, dtype=bool)}


@pytest.mark.parametrize("band", [1, 4, 16, 256])
def test_regions_equal_flood_fill(spark, band):
    m = masks()
    data = [(k, int(y), int(x), int(v)) for k, a in m.items() for (y, x), v in np.ndenumerate(a)]
    cells = spark.createDataFrame(data, "image string, y int, x int, gt int").repartition(5)
    found = {}
    for r in regions.mask_regions(cells, band).collect():
        assert r.run == r.y << 31 | r.x0
        found |= {(r.image, r.y, x): r.region for x in range(r.x0, r.x1 + 1)}
    assert found == flooded(m)


def test_bands_over_batches(spark):
    """Bands that span several Arrow batches are still whole."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_regions_equal_flood_fill(spark, 8)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_regions_of_nothing(spark):
    assert regions.mask_regions(spark.createDataFrame([], "image long, y int, x int, gt int")).count() == 0
    assert regions.mask_regions(spark.createDataFrame([(None, 0, 0, 1), (1, 0, 0, 0)], "image long, y int, x int, gt int")).count() == 0
