"""Mergeable metrics, epoch order, sizes of masks, contexts that aren't square, image modes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import png
from tilewise.operators import evaluate, sampling, tiling
from tilewise.plans.evaluation import Moments
from tilewise.sources import images


class Counts:
    """Counts rows, and how many updates and merges made the state."""

    def update(self, state, rows):
        n, most = state or (0, 0)
        return n + len(rows), max(most, len(rows))

    def merge(self, a, b):
        return a[0] + b[0], max(a[1], b[1])

    def finish(self, state):
        return {"n": state[0], "most_at_once": state[1]}


class Fails(Counts):
    def finish(self, state):
        raise RuntimeError("metric broke")


def scores(spark, n=900):
    rng = np.random.default_rng(7)
    rows = [(["hot", "hot", "hot", "cold", None][int(rng.integers(5))], float(rng.normal()), 0) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "clsname string, score double, label int").repartition(9)


def test_mergeable_metric_never_holds_a_category(spark):
    rows, d = scores(spark)
    got = {r.clsname: r for r in evaluate.mergeable_metric(Counts(), "n long, most_at_once long")(d).collect()}
    want = pd.Series([r[0] for r in rows]).value_counts(dropna=False)
    assert {k: r.n for k, r in got.items()} == {None if pd.isna(k) else k: int(v) for k, v in want.items()}
    assert got["hot"].most_at_once < got["hot"].n / 4


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_moments_merge(spark, monkeypatch, levels):
    monkeypatch.setattr(evaluate, "FAN_IN", 2)
    rows, d = scores(spark)
    got = {r.clsname: r for r in evaluate.mergeable_metric(Moments(), "n_images long, mean_score double, variance double", levels)(d).collect()}
    for k in ("hot", "cold", None):
        own = np.array([s for c, s, _ in rows if c == k])
        assert got[k].n_images == len(own) and abs(got[k].mean_score - own.mean()) < 1e-12 and abs(got[k].variance - own.var()) < 1e-12


def test_what_a_metric_raises_fails_the_job(spark):
    _, d = scores(spark, 50)
    with pytest.raises(Exception, match="metric broke"):
        evaluate.mergeable_metric(Fails(), "n long, most_at_once long")(d).collect()
    assert evaluate.mergeable_metric(Counts(), "n long, most_at_once long")(d.limit(0)).count() == 0


def test_epoch_order(spark):
    tiles = spark.createDataFrame([(f"i{i}", t) for i in range(20) for t in range(i % 6 + 1)], "image string, tile int").repartition(4)
    orders = []
    for epoch in range(3):
        got = sampling.epoch_order(sampling.fair_sample(tiles, "image", "tile", 3, epoch), "image", epoch).orderBy("position").collect()
        assert [r.position for r in got] == list(range(sum(min(3, i % 6 + 1) for i in range(20))))
        order = list(dict.fromkeys(r.image for r in got))
        assert len(order) == 20 and all(r.image == got[k - 1].image or r.step == 0 for k, r in enumerate(got) if k)  # a source's tiles stand together
        orders.append(tuple(order))
    assert len(set(orders)) == 3
    again = sampling.epoch_order(sampling.fair_sample(tiles.repartition(2), "image", "tile", 3, 1), "image", 1).orderBy("position").collect()
    assert tuple(dict.fromkeys(r.image for r in again)) == orders[1]


def test_masks_of_another_size_are_refused(spark):
    pred = spark.createDataFrame([(i, "a", y, x, 0.5) for i in range(2) for y in range(2) for x in range(3)], "image long, clsname string, y int, x int, pred double")
    truth = spark.createDataFrame([(0, 0, 1, 1)], "image long, y int, x int, gt int")  # sparse: sizes can't be read off it
    sizes = spark.createDataFrame([(0, 3, 2), (1, 3, 2)], "image long, width int, height int")
    pairs = evaluate.pixel_pairs(pred, truth, sizes, sizes.filter("image = 0"))
    assert pairs.count() == 12 and pairs.agg(F.sum("gt")).first()[0] == 1
    wrong = sizes.filter("image = 0").withColumn("height", F.lit(3))
    with pytest.raises(Exception, match="a mask of 3x3 for a map of 3x2"):
        evaluate.pixel_metrics(evaluate.pixel_pairs(pred, truth, sizes, wrong)).collect()
    assert [tuple(r) for r in evaluate.size_faults(sizes, wrong).collect()] == [(0, "3x2", "3x3")]


def test_contexts_of_oblong_tiles(spark):
    """The enclosing tile found by closed form is the first one that a search finds."""
    images_ = spark.createDataFrame([("a", 200, 90), ("b", 40, 300), ("c", 333, 334)], "image_path string, width int, height int")
    patch, stride, factors = (48, 32), (40, 16), (0, 1, 2)
    got = {(r.image_path, r.tile_id, r.context_scale): (r.cx, r.cy, r.cw, r.ch) for r in tiling.with_contexts(tiling.tiles(images_, patch, stride), patch, stride, factors).collect()}
    every = tiling.tiles(images_, patch, stride, factors).collect()
    main = [t for t in every if t.scale == 0]
    assert len(got) == 2 * len(main)
    for m in main:
        for f in (1, 2):
            around = [t for t in every if t.image_path == m.image_path and t.scale == f and t.x <= m.x and t.y <= m.y and t.x + t.w >= m.x + m.w and t.y + t.h >= m.y + m.h]
            first = min(around, key=lambda t: t.tile_id)
            assert got[m.image_path, m.tile_id, f] == (first.x, first.y, first.w, first.h)


def test_image_modes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "BLOCK", 2)
    rng = np.random.default_rng(1)
    colour, grey = rng.integers(0, 256, (5, 3, 3)), rng.integers(0, 256, (4, 6))
    png(tmp_path / "c.png", colour)
    png(tmp_path / "g.png", grey)
    (tmp_path / "x.png").write_bytes(b"no image")

    def read(mode):
        out = {}
        for r in images.image_rows(spark, str(tmp_path), mode).collect():
            out.setdefault(r.path.rsplit("/", 1)[-1], {})[r.channel, r.y] = r.row
        return {k: np.array([[v[c, y] for y in range(1 + max(y for _, y in v))] for c in range(1 + max(c for c, _ in v))]) for k, v in out.items()}

    raw, rgb, l_ = read(None), read("RGB"), read("L")
    assert set(raw) == {"c.png", "g.png"}
    assert (raw["c.png"] == colour.transpose(2, 0, 1)).all() and (raw["g.png"] == grey[None]).all()
    assert (rgb["c.png"] == raw["c.png"]).all() and (rgb["g.png"] == np.repeat(grey[None], 3, 0)).all()
    want = (colour[..., 0] * 19595 + colour[..., 1] * 38470 + colour[..., 2] * 7471 + 0x8000) >> 16
    assert (l_["c.png"] == want[None]).all() and (l_["g.png"] == grey[None]).all()
    with pytest.raises(ValueError, match="mode"):
        images.image_rows(spark, str(tmp_path), "CMYK")
