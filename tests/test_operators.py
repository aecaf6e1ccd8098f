"""Literal cases of the operators, and brute-force checks."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from tilewise.operators import calibrate, decide, evaluate, features, manifest, pixels, regions, sampling, stitch, tiling
from tilewise.plans import catalog
from tilewise.sources import images as image_source
from tilewise.streaming import decisions


def png(path, array):
    """Writes an 8-bit grey or RGB PNG."""
    a = np.asarray(array, np.uint8)
    h, w = a.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def cells(spark, maps, value="v"):
    rows = [(i, y, x, float(v)) for i, m in enumerate(maps) for y, r in enumerate(m) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, f"image long, y int, x int, {value} double")


def test_tiles_of_small_images(spark):
    images = spark.createDataFrame([("a", 32, 32), ("b", 32, 32)], "image_path string, width int, height int")
    assert tiling.tiles(images, 16).count() == 8
    odd = spark.createDataFrame([("c", 40, 10)], "image_path string, width int, height int")
    got = [(r.x, r.y, r.valid_w, r.valid_h) for r in tiling.tiles(odd, 16).orderBy("tile_id").collect()]
    assert got == [(0, 0, 16, 10), (16, 0, 16, 10), (24, 0, 16, 10)]


@pytest.mark.parametrize("patch, stride, factors", [(10, None, [0]), (16, 17, [0]), (16, 0, [0]), (16, 16, [1]), (16, 16, [0, 0]), (16, 16, [])])
def test_tiling_arguments(patch, stride, factors):
    with pytest.raises(ValueError):
        tiling.check_spec(patch, stride, factors)


def test_top_k_and_image_score(spark):
    d = spark.createDataFrame([(0, 0, 0.01), (0, 1, 0.02), (0, 2, 0.03), (0, 3, 0.95)], "tile int, token int, distance double")
    assert features.top_k_mean(d, ["tile"], 2).first().score == pytest.approx(0.49)
    assert features.top_k_mean(d, ["tile"], 9).first().score == pytest.approx(0.2525)
    s = spark.createDataFrame([(0, 0.02), (0, 0.03), (0, 0.91), (0, 0.04), (1, 0.12), (1, 0.08)], "image int, score double")
    assert [round(r.score, 4) for r in features.image_scores(s, ["image"]).orderBy("image").collect()] == [0.91, 0.12]


def test_layer_max_after_upsampling(spark):
    """Two layers on one row of two tokens: opposite ends light up, the middle is half."""
    maps = cells(spark, [[[1.0, 0.0]], [[0.0, 1.0]]])
    sizes = spark.createDataFrame([(0, 2, 1), (1, 2, 1)], "image long, width int, height int")
    up = pixels.resize_bilinear(maps, sizes, 3, 1, align_corners=True)
    assert [r.v for r in up.groupBy("x").agg(F.max("v").alias("v")).orderBy("x").collect()] == [1.0, 0.5, 1.0]


def test_token_distance_bounds(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    d = features.token_distance(spark.createDataFrame(rows, "enc array<float>, dec array<double>"))
    assert [r.distance for r in d.collect()] == [0.0, 2.0, 1.0]


def test_calibration(spark, tmp_path):
    maps = cells(spark, [[[0.1, 0.2]], [[0.3, 0.4]]], "pred")
    stats = calibrate.map_quantile(maps, 0.5, ["image"]).withColumn("clsname", F.lit("a")).withColumn("score", F.col("pixel_stat"))
    cal = calibrate.calibrate(stats, 0.5)
    whole = cal.filter("clsname IS NULL").first()
    assert whole.normal_image_count == 2 and whole.pixel_threshold == pytest.approx(0.25)
    calibrate.save(cal, str(tmp_path / "c"))
    assert calibrate.load(spark, str(tmp_path / "c")).count() == 2
    cal.drop("pixel_threshold").write.parquet(str(tmp_path / "old"))
    assert calibrate.load(spark, str(tmp_path / "old")).filter("pixel_threshold IS NOT NULL").count() == 0
    out = json.loads(calibrate.export_json(cal).first().value)
    assert out["categories"]["a"]["normal_image_count"] == 2
    with pytest.raises(ValueError):
        calibrate.calibrate(stats, 1.0)


def test_lookup_falls_back(spark):
    cal = spark.createDataFrame([(None, 10, 0.5, None), ("a", 5, 0.7, 0.1)], "clsname string, normal_image_count long, threshold double, pixel_threshold double")
    rows = spark.createDataFrame([("a", 0.6), ("b", 0.6)], "clsname string, score double")
    got = {r.clsname: r for r in decide.decide_images(rows, cal).collect()}
    assert not got["a"].is_defect and got["b"].is_defect
    assert got["a"].pixel_threshold is None  # no global pixel threshold: none at all


def test_pixel_decision_is_not_gated(spark):
    d = decide.decide_pixels(cells(spark, [[[0.1, 0.8]]]).withColumn("t", F.lit(0.5)), "v", "t")
    assert [r.is_anomalous for r in d.orderBy("x").collect()] == [False, True]


def test_prediction_record(spark, tmp_path):
    p = spark.createDataFrame([(0, "a.png", "x", None, None, 1.5, True, "masks/000000_a.png", 2)], "ordinal long, filename string, clsname string, label int, label_name string, score double, is_defect boolean, prediction_mask string, anomaly_pixel_count long")
    assert json.loads(decide.prediction_json(p).first().value) == {"filename": "a.png", "clsname": "x", "label": None, "label_name": None, "score": 1.5, "is_defect": True, "prediction_mask": "masks/000000_a.png", "anomaly_pixel_count": 2}
    assert p.select(decide.mask_name().alias("m")).first().m == "masks/000000_a.png"
    decide.write_predictions(p, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 1


@pytest.mark.parametrize("records, image, pixel", [
    ([("a", 0, None), ("a", 1, "m")], True, True),
    ([("a", 0, None), ("a", 1, None)], True, False),
    ([("a", 0, None), ("b", 0, None), ("b", 1, "m")], False, False),
    ([("a", 0, None), ("a", None, None), ("a", 1, "m")], False, False),
    ([], False, False),
])
def test_gates(spark, records, image, pixel):
    rows = spark.createDataFrame(records, "clsname string, label int, mask string")
    g = evaluate.annotation_gates(rows).first()
    assert (g.image_ready, g.pixel_ready) == (image, pixel)


def test_constant_scores(spark):
    rows = spark.createDataFrame([(0, "a", 0, 0, 1.0, 1), (0, "a", 0, 1, 1.0, 0)], "image long, clsname string, y int, x int, pred float, gt int")
    m = evaluate.pixel_metrics(rows, 64).first()
    assert (m.pixel_auroc, m.pixel_ap) == (0.5, 0.5) and m.pixel_f1 == pytest.approx(2 / 3) and m.pixel_threshold == 1.0


def exact_metrics(score, label):
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    last = np.append(np.nonzero(np.diff(s))[0], len(s) - 1)
    tp, fp = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    tpr, fpr = tp / y.sum(), fp / (1 - y).sum()
    area = np.trapezoid(np.append(0, tpr), np.append(0, fpr))
    return area, float((np.diff(np.append(0, tpr)) * tp / (tp + fp)).sum())


def test_histogram_metrics_are_close_to_exact_ones(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 2000)
    score = (rng.normal(size=2000) + label).astype(np.float32)
    pdf = pd.DataFrame({"image": 0, "clsname": "a", "y": 0, "x": range(2000), "pred": score, "gt": label.astype(np.int32)})
    m = evaluate.pixel_metrics(spark.createDataFrame(pdf), 65_536).first()
    area, ap = exact_metrics(score.astype(float), label)
    assert m.pixel_auroc == pytest.approx(area, abs=1e-3) and m.pixel_ap == pytest.approx(ap, abs=1e-3)


def test_metrics_by_category(spark):
    rows = spark.createDataFrame([("b", 0.0), ("a", 1.0), ("c", 2.0), ("a", 3.0)], "clsname string, score double")
    m = evaluate.metrics_by_category(rows, {"sum": evaluate.python_metric(lambda r: {"n": len(r), "total": float(r["score"].sum())}, "n long, total double")})
    assert [tuple(r) for r in m.collect()] == [("a", 2, 4.0), ("b", 1, 0.0), ("c", 1, 2.0)]
    with pytest.raises(ValueError):
        evaluate.metrics_by_category(rows, {k: evaluate.python_metric(lambda r: {"n": 1}, "n long") for k in "xy"})


def test_display_scale(spark):
    fixed = pixels.display_scale(cells(spark, [[[0.0, 0.25, 0.5, 1.0]]]).withColumn("threshold", F.lit(0.5)))
    assert [r.shown for r in fixed.orderBy("x").collect()] == [0.0, 0.25, 0.5, 1.0]
    flat = pixels.display_scale(cells(spark, [[[3.0, 3.0]]]).withColumn("threshold", F.lit(None).cast("double")))
    assert [r.shown for r in flat.collect()] == [0.0, 0.0]


def test_fair_sample_covers_all_before_it_repeats(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([0, 0, 0, 1, 1, 2] + [3] * 16)], "tile int, source int")
    counts = {r.source: r["count"] for r in sampling.fair_sample(rows, "source", "tile", 2, 0).groupBy("source").count().collect()}
    assert counts == {0: 2, 1: 2, 2: 1, 3: 2}
    big = rows.filter("source = 3")
    seen = [r.tile for e in range(4) for r in sampling.fair_sample(big, "source", "tile", 4, e).collect()]
    assert len(seen) == 16 and len(set(seen)) == 16


def test_round_robin(spark):
    got = sampling.round_robin(spark.range(5).withColumn("g", F.lit(1)), "id", 2, within="g").orderBy("id")
    assert [r.bucket for r in got.collect()] == [0, 1, 0, 1, 0]


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = n
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return label, n


def brute_pro(preds, masks, limit, n):
    lo, hi = min(p.min() for p in preds), max(p.max() for p in preds)
    eps = max(np.finfo(float).eps, abs(hi) * 1e-12, abs(lo) * 1e-12)
    ts = np.linspace(hi + eps, lo - eps, n)
    fpr = [sum((p[m == 0] >= t).sum() for p, m in zip(preds, masks)) / sum((m == 0).sum() for m in masks) for t in ts]
    shares = []
    for p, m in zip(preds, masks):
        label, k = flood(m)
        shares += [[(p[label == i] >= t).mean() for t in ts] for i in range(1, k + 1)]
    pro = np.mean(shares, axis=0)
    f = np.unique(fpr)
    e = np.array([pro[np.array(fpr) == v].max() for v in f])
    fs, ps = list(f[f < limit]) + [limit], list(e[f < limit]) + [np.interp(limit, f, e)]
    return np.trapezoid(ps, fs) / limit


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pro_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    preds = [rng.random((9, 7)).round(2).astype(np.float32) for _ in range(3)]
    masks = [(rng.random((9, 7)) < 0.4).astype(int) for _ in range(3)]
    rows = [(i, "a", y, x, float(preds[i][y, x]), int(masks[i][y, x])) for i in range(3) for y in range(9) for x in range(7)]
    pairs = spark.createDataFrame(rows, "image long, clsname string, y int, x int, pred float, gt int")
    found = regions.mask_regions(pairs)
    assert found.select("image", "region").distinct().count() == sum(flood(m)[1] for m in masks)
    got = regions.pro_area(regions.pro_curve(pairs, found, 31), 0.3).first().pro
    assert got == pytest.approx(brute_pro([p.astype(float) for p in preds], masks, 0.3, 31), abs=1e-9)


def test_stitching_gives_the_map_back(spark):
    rng = np.random.default_rng(3)
    m = rng.random((40, 24)).astype(np.float32)
    images = spark.createDataFrame([(0, 24, 40)], "image long, width int, height int")
    tiles = tiling.tiles(images, 16, 8)
    whole = cells(spark, [m])
    maps = tiles.join(stitch.tile_cells(tiles, whole, 16), ["image", "tile_id"])
    out = stitch.overlap_add(maps, 16)
    assert stitch.coverage_gaps(images, out).count() == 0
    got = np.zeros_like(m)
    for r in out.collect():
        got[r.y, r.x] = r.v
    assert np.abs(got - m).max() < 1e-6


def test_low_rank_model_rebuilds_normals(spark):
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(2, 6))
    normal = rng.normal(size=(40, 2)) @ basis
    odd = rng.normal(size=(5, 6)) * 3
    rows = [(i, 0, True, 0, v.tolist()) for i, v in enumerate(normal)] + [(100 + i, 0, False, 0, v.tolist()) for i, v in enumerate(odd)]
    t = spark.createDataFrame(rows, "image long, clsname int, normal boolean, token int, enc array<double>")
    d = features.token_distance(features.reconstruct_low_rank(t, 2)).groupBy("normal").agg(F.max("distance").alias("hi"), F.min("distance").alias("lo"))
    got = {r.normal: r for r in d.collect()}
    assert got[True].hi < 1e-9 < got[False].lo


def test_model_plug_in(spark):
    tiles = spark.createDataFrame([(0, 1.0), (1, 2.0)], "tile long, v double")
    out = features.score_tiles(tiles, lambda pdf: pdf.assign(v=pdf["v"] * 2), "tile long, v double")
    assert sorted(r.v for r in out.collect()) == [2.0, 4.0]


def test_manifest_faults_stop_the_build(spark, tmp_path):
    lines = ['{"filename": "line_a/001.bmp", "split": "train", "clsname": "panel", "label": 0}', '{"filename": "a.bmp", "split": "test", "clsname": "fabric", "mask": "m/a.png"}', "", '{"filename": "b.bmp", "split": "train", "clsname": "panel", "label": 1}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    parsed = manifest.parse(manifest.read_lines(spark, str(tmp_path / "m.jsonl")))
    assert {(r.ordinal, r.rule) for r in manifest.all_faults(parsed).collect()} == {(2, "blank"), (3, "not normal and mask-free")}
    with pytest.raises(ValueError, match="line 3"):
        manifest.require_empty(manifest.all_faults(parsed), "manifest")
    u = manifest.unified(manifest.clean(parsed)).orderBy("ordinal").collect()
    assert [(r.filename, r.mask, r.label) for r in u] == [("images/train/panel/line_a/001.bmp", None, 0), ("images/test/fabric/a.bmp", "annotations/mask/a.png", None)]
    manifest.write_splits(manifest.unified(manifest.clean(parsed)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_image_files(spark, tmp_path):
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    png(tmp_path / "a.png", rgb)
    png(tmp_path / "b.png", np.array([[7, 8]], np.uint8))
    (tmp_path / "c.png").write_bytes(b"no image")
    sizes = {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in image_source.png_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"a.png": (3, 2), "b.png": (2, 1)}
    got = np.zeros((2, 3, 3), int)
    for r in image_source.pixels(spark, str(tmp_path)).filter("path LIKE '%a.png'").collect():
        got[r.y, r.x, r.channel] = r.v
    assert (got == rgb).all()
    assert image_source.listing(spark, str(tmp_path)).count() == 3


def test_foreground(spark):
    image = cells(spark, [[[1, 2, 3]], [[4, 5, 6]]])
    fg = pixels.resize_nearest(cells(spark, [[[255, 0]]]), spark.createDataFrame([(0, 2, 1)], "image long, width int, height int"), 3, 1)
    got = {(r.image, r.x): r.v for r in pixels.mask_foreground(image, fg).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 0, (1, 0): 4, (1, 1): 5, (1, 2): 6}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i / 10) for i in range(20)], "event_id long, clsname string, score double")
    cal = calibrate.calibrate(rows.filter("event_id < 10").select("clsname", "score"), 0.5)
    rows.write.parquet(str(tmp_path / "in"))
    stream = decisions.decide_stream(decisions.score_stream(spark, str(tmp_path / "in"), "event_id long, clsname string, score double"), cal)
    decisions.write_decisions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = sorted((r.event_id, r.is_defect) for r in decide.decide_images(rows, cal).collect())
    assert sorted((r.event_id, r.is_defect) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_full_pixel_queries_have_all_bins(spark):
    """Their bins tell scores apart that fall together among 1,024."""
    full, short = (catalog.QUERIES[n](spark, DATA) for n in ("pixel_histogram_full", "pixel_histogram"))
    count = lambda h: h.agg(F.count("*").alias("n"), F.max("bin").alias("last"), F.sum(F.col("pos") + F.col("neg")).alias("pixels")).first()
    a, b = count(full), count(short)
    assert a.last == evaluate.BINS - 1 and a.n > b.n and a.pixels == b.pixels
    for name in ("pixel_histogram_full", "pixel_curve_full", "pixel_ap_full", "pixel_f1_full"):
        assert "65536" in catalog.SQL[name] and "1024" not in catalog.SQL[name]


def test_all_tiles_have_their_pixels(spark):
    """Nine tiles of sixteen pixels for each image; only the last row and column of tiles overhang."""
    got = catalog.QUERIES["tile_pixels_all"](spark, DATA).toPandas()
    images = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert len(got) == images * 9 * 16 and not got.duplicated(["image", "tile_id", "ty", "tx"]).any()
    out = ((got.tile_id >= 6) & (got.ty == 3)) | ((got.tile_id % 3 == 2) & (got.tx == 3))
    assert (got.z[out] == 0).all() and (got.z[~out] == got.v[~out]).all()


def test_manifest_labels_paths_and_splits(spark, tmp_path):
    lines = [
        '{"filename": "a.png", "split": "train", "clsname": "\\tc\\n", "label": 0.0}',
        '{"filename": "b.png", "split": "train", "clsname": "c", "label": 0.5}',
        '{"filename": "c.png", "split": "train", "clsname": "c", "label": 0, "foreground": "x/../../y.png"}',
        '{"filename": "d.png", "split": "train", "clsname": "c", "label": "0"}',
        '{"filename": "e.png", "split": "train", "clsname": "c", "label": 0, "mask": "/m.png"}',
        '{"filename": "f.png", "split": "train", "clsname": "c", "label": 0, "mask": "", "roi": [0, 0, 8, 8]}',
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    read = manifest.read_lines(spark, str(tmp_path / "m.jsonl"))
    assert [(r.ordinal, r.value) for r in read.orderBy("ordinal").collect()] == list(enumerate(lines))
    parsed = manifest.parse(read)
    got = {(r.ordinal, r.rule) for r in manifest.all_faults(parsed).collect()}
    bad = "not normal and mask-free"
    assert got == {(1, "label is neither 0 nor 1"), (1, bad), (2, "foreground: outside the root"), (3, "label is not a number"), (3, bad), (4, "mask: absolute path"), (4, bad)}
    clean = manifest.clean(parsed)
    assert {(r.ordinal, r.label, r.clsname) for r in manifest.training_set(clean, "/r").collect()} == {(0, 0, "c"), (5, 0, "c")}
    sizes = spark.createDataFrame([(5, 8, 7), (0, 1, 1)], "ordinal long, width int, height int")
    assert [tuple(r) for r in manifest.roi_outside(clean, sizes).collect()] == [(5, "roi exceeds the image")]
    manifest.write_splits(manifest.unified(clean), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/split=train")).count() == 2 and spark.read.text(str(tmp_path / "out/split=test")).count() == 0


def test_mask_table(spark, tmp_path):
    cells = spark.createDataFrame([("a", y, x, y == x) for y in range(3) for x in range(4)], "name string, y int, x int, is_anomalous boolean")
    decide.write_masks(decide.mask_rows(cells, ["name"]), str(tmp_path / "masks"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "masks")).collect()) == [("a", 0, "1000"), ("a", 1, "0100"), ("a", 2, "0010")]


def test_a_tile_score_must_be_finite(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", float("nan"))], "image string, score double")
    with pytest.raises(Exception, match="not finite"):
        features.image_scores(rows, ["image"]).collect()
