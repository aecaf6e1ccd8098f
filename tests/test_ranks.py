"""Running sums and quantiles over ranges, against NumPy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import calibrate, evaluate, features, ranks


def rows_of(spark, rng, n=3000):
    """One group holds most rows; one has a null key; values repeat."""
    groups = ["hot"] * 6 + ["cold", None]
    data = [(groups[int(rng.integers(8))], float(round(rng.normal(), 2)) if rng.random() > 0.05 else None) for _ in range(n)]
    return data, spark.createDataFrame(data, "g string, value double").repartition(7)


@pytest.mark.parametrize("p", [0.0, 0.013, 0.5, 0.95, 1.0])
def test_quantiles_equal_numpy(spark, p):
    data, rows = rows_of(spark, np.random.default_rng(1))
    got = {r.g: r["quantile"] for r in ranks.quantiles(rows.withColumn("share", F.lit(p)), ["g"]).collect()}
    want = {g: np.quantile([v for k, v in data if k == g and v is not None], p) for g in {g for g, _ in data}}
    assert got.keys() == want.keys()
    assert all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_quantiles_of_odd_values(spark):
    rows = spark.createDataFrame([("one", 3.0), ("nan", 1.0), ("nan", float("nan")), ("inf", float("-inf")), ("inf", float("inf")), ("inf", 2.0), ("none", None), ("same", float("inf")), ("same", float("inf"))], "g string, value double")
    got = {r.g: r["quantile"] for r in ranks.quantiles(rows.withColumn("share", F.lit(0.5)), ["g"]).collect()}
    assert set(got) == {"one", "nan", "inf", "same"}
    assert got["one"] == 3.0 and np.isnan(got["nan"]) and got["inf"] == 2.0 and got["same"] == float("inf")
    assert ranks.quantiles(rows.withColumn("share", F.lit(0.5)).limit(0), ["g"]).count() == 0


def test_running_sums_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    data = [(["hot", "hot", "hot", None][int(rng.integers(4))], i, int(rng.integers(9))) for i in range(2000)]
    got = ranks.running(spark.createDataFrame(data, "g string, i long, n long").repartition(5), ["g"], [F.desc("i")], ["n"]).collect()
    total, want = {}, {}
    for g, i, n in sorted(data, key=lambda r: -r[1]):
        total[g] = total.get(g, 0) + n
        want[i] = total[g]
    assert len(got) == len(data)
    assert all(r.up_to_n == want[r.i] and r.all_n == total[r.g] for r in got)


def test_calibration_has_no_single_task(spark):
    """The plan has no percentile, and windows are cut by ranges."""
    data, rows = rows_of(spark, np.random.default_rng(3))
    c = calibrate.calibrate(rows.withColumnsRenamed({"g": "clsname", "value": "score"}), 0.9)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    got = {r.clsname: (r.normal_image_count, r.threshold, r.pixel_threshold) for r in c.collect()}
    every = [v for _, v in data if v is not None]
    assert got[None][0] == len(data) and abs(got[None][1] - np.quantile(every, 0.9)) < 1e-12 and got[None][2] is None
    assert set(got) == {None, "hot", "cold"}


def test_calibration_of_nothing(spark):
    got = calibrate.calibrate(spark.createDataFrame([], "clsname string, score double"), 0.9).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, None)]


def test_curve_of_a_hot_category(spark):
    rng = np.random.default_rng(4)
    data = [("hot" if i % 9 else "cold", float(rng.integers(50)), int(rng.random() < 0.4)) for i in range(1500)] + [("lone", 1.0, 1)]
    rows = spark.createDataFrame(data, "clsname string, score double, label int").repartition(6)
    curve = evaluate.binary_curve(rows)
    area = {r.clsname: r.image_auroc for r in evaluate.auroc(curve).collect()}
    assert set(area) == {"hot", "cold"}  # a category with one kind of label has no curve
    for g in area:
        pos, neg = ([s for k, s, y in data if k == g and y == want] for want in (1, 0))
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert abs(area[g] - wins / len(pos) / len(neg)) < 1e-9
    last = {r.clsname: (r.tp, r.fp) for r in curve.groupBy("clsname").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp")).collect()}
    assert last["hot"] == (sum(y for k, _, y in data if k == "hot"), sum(1 - y for k, _, y in data if k == "hot"))


def test_hard_mining_in_ranges(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), "hot" if i % 7 else None, float(rng.integers(100))) for i in range(900)]
    rows = spark.createDataFrame(data, "image long, clsname string, distance double").repartition(5)
    got = {r.image: r.weight for r in features.hard_mining_weights(rows, ["clsname"], ["image"], 0.3, 0.1).collect()}
    for g in ("hot", None):
        own = sorted((d, i) for i, k, d in data if k == g)
        easy = {i for _, i in own[: int(len(own) * 0.3)]}
        assert {i for _, i in own if got[i] == 0.1} == easy
