"""Calibration stores, manifests of several files, and streams that start again."""

import pytest
from pyspark.sql import functions as F

from tilewise.operators import calibrate, decide, manifest
from tilewise.sources import storage
from tilewise.streaming import decisions

CAL = "clsname string, normal_image_count long, threshold double, pixel_threshold double"


def stored(spark, threshold):
    return spark.createDataFrame([(None, 3, threshold, None), ("a", 2, threshold / 2, 0.5)], CAL)


def current(spark, path):
    return {r.clsname: r.threshold for r in calibrate.load(spark, path).collect()}


def test_a_store_keeps_the_old_calibration_until_the_new_one_is_whole(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert calibrate.load(spark, path, required=False) is None
    with pytest.raises(FileNotFoundError):
        calibrate.load(spark, path)
    calibrate.save(stored(spark, 1.0), path)
    assert current(spark, path) == {None: 1.0, "a": 0.5}
    before = calibrate.load(spark, path)
    broken = stored(spark, 2.0).withColumn("threshold", F.when(F.col("clsname") == "a", F.raise_error(F.lit("half-way")).cast("double")).otherwise(F.col("threshold")))
    with pytest.raises(Exception, match="half-way"):
        calibrate.save(broken, path)
    assert current(spark, path) == {None: 1.0, "a": 0.5}
    calibrate.save(stored(spark, 4.0), path)
    assert current(spark, path) == {None: 4.0, "a": 2.0}
    assert before.count() == 2  # a reader that began before the swap still reads its version


def test_a_failed_swap_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    calibrate.save(stored(spark, 1.0), path)

    def fails(*_):
        raise OSError("no room")

    monkeypatch.setattr(calibrate, "swap", fails)
    with pytest.raises(OSError, match="no room"):
        calibrate.save(stored(spark, 8.0), path)
    assert current(spark, path) == {None: 1.0, "a": 0.5}


def test_old_versions_go(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for k in range(6):
        calibrate.save(stored(spark, float(k)), path)
    assert current(spark, path)[None] == 5.0
    assert len(storage.names(spark, f"{path}/versions")) == calibrate.KEPT + 1
    assert [x for x in storage.names(spark, path) if x != "versions" and not x.startswith(".")] == [calibrate.POINTER]


def test_older_stores_are_read(spark, tmp_path):
    stored(spark, 1.0).drop("pixel_threshold").write.parquet(f"{tmp_path}/old")
    got = calibrate.load(spark, f"{tmp_path}/old")
    assert got.filter("threshold = 1.0").count() == 1 and got.filter("pixel_threshold IS NOT NULL").count() == 0


def test_lines_of_several_files(spark, tmp_path):
    """Numbers don't depend on how files are cut into blocks and dealt to tasks."""
    texts = {"b/2.jsonl": [f'{{"b": {i}}}' for i in range(300)], "a/1.jsonl": ["one", "", "  three"], "c.jsonl": [], "z.jsonl": ["x" * 4000, "last"]}
    for name, lines in texts.items():
        f = tmp_path / "m" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("".join(f"{x}\n" for x in lines))
    want = [(name.rsplit("/", 1)[-1], k, x) for name in sorted(texts) for k, x in enumerate(texts[name])]
    want = [(name, k, ordinal, x) for ordinal, (name, k, x) in enumerate(want)]
    conf = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in conf}
    for changed in ({}, conf):
        for k, v in changed.items():
            spark.conf.set(k, v)
        try:
            got = sorted(((r.file.rsplit("/", 1)[-1], r.line, r.ordinal, r.value) for r in manifest.read_files(spark, f"{tmp_path}/m").collect()), key=lambda r: r[2])
            parts = manifest.read_files(spark, f"{tmp_path}/m").rdd.getNumPartitions()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert got == want and parts >= 1
    assert [r.value for r in manifest.read_lines(spark, f"{tmp_path}/m/a").orderBy("ordinal").collect()] == texts["a/1.jsonl"]


def test_an_empty_manifest_is_an_error(spark):
    lines = spark.createDataFrame([(0, "  "), (1, "[1]")], "ordinal long, value string")
    with pytest.raises(ValueError, match="no records"):
        manifest.require_records(manifest.parse(lines))
    with pytest.raises(ValueError, match="no records"):
        manifest.require_records(manifest.parse(lines.limit(0)))
    assert manifest.require_records(manifest.parse(spark.createDataFrame([(0, "{}")], "ordinal long, value string"))).count() == 1


def test_white_space_is_no_path(spark):
    d = spark.createDataFrame([("\t",), (" \n",), ("a\tb",), ("",), (None,)], "filename string").select("filename", manifest.path_fault("filename").alias("f"))
    assert {r.filename: r.f for r in d.collect()} == {"\t": "empty path", " \n": "empty path", "a\tb": None, "": "empty path", None: "empty path"}


def test_a_stream_starts_again_over_growing_input(spark, tmp_path):
    scores = spark.createDataFrame([(i, ["a", "b", None][i % 3], i / 10) for i in range(60)], "event_id long, clsname string, score double")
    cal = stored(spark, 3.0)
    arrivals = [scores.filter(f"event_id % 4 = {k}") for k in range(4)]
    root = f"file://{tmp_path}/stream"
    first = decisions.decide_arrivals(arrivals[:2], cal, root)
    key = lambda d: sorted((r.event_id, r.is_defect) for r in d.select("event_id", "is_defect").collect())
    rule = decide.decide_images(scores, cal)
    assert key(first) == key(rule.filter("event_id % 4 < 2"))
    # nothing new, then the rest: each decision stands in the sink once
    assert key(decisions.decide_arrivals([arrivals[0].limit(0)], cal, root)) == key(first)
    assert key(decisions.decide_arrivals(arrivals[2:], cal, root)) == key(rule)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())
