"""Queries on manifests: rules, splits, paths and contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.operators import manifest as m
from tilewise.sources import tables
from tilewise.sources.storage import shared_dir

ROOT = "/data"

#: The manifest lines and their records, by DuckDB's own JSON functions.
REC = f"""lines AS (SELECT doc_id AS ordinal, {tables.MANIFEST_VALUE.replace("AS STRING", "AS VARCHAR")} AS value FROM documents LEFT JOIN labels USING (doc_id)),
kinds AS (SELECT *, CASE WHEN trim(value) = '' THEN 'blank' WHEN NOT json_valid(value) THEN 'invalid' WHEN json_type(value) = 'OBJECT' THEN 'record' ELSE 'not an object' END AS kind FROM lines),
rec AS (SELECT ordinal, value, value ->> '$.filename' AS filename, value ->> '$.split' AS split, value ->> '$.clsname' AS clsname, value ->> '$.label_name' AS label_name, value ->> '$.mask' AS mask, value ->> '$.foreground' AS foreground,
  json_type(value, '$.label') AS lt, CASE WHEN json_type(value, '$.label') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (value ->> '$.label')::DOUBLE = floor((value ->> '$.label')::DOUBLE) THEN (value ->> '$.label')::DOUBLE::INT END AS label, json_type(value, '$.roi') AS rt,
  CASE WHEN json_type(value, '$.roi') = 'ARRAY' THEN json_extract(value, '$.roi[*]') END AS roi FROM kinds WHERE kind = 'record'),
parts AS (SELECT *, list_filter(string_split(filename, '/'), lambda p: p <> '' AND p <> '.') AS raw FROM rec),
fold AS (SELECT *, CASE WHEN len(raw) > 2 AND raw[1] = 'a' AND raw[2] = '..' THEN CASE WHEN raw[3] = '..' THEN raw[3:] ELSE raw[3:] END ELSE raw END AS f FROM parts)"""
PATH_FAULT = "CASE WHEN coalesce(trim(filename), '') = '' THEN 'empty path' WHEN starts_with(filename, '/') THEN 'absolute path' WHEN len(f) = 0 OR f[1] = '..' THEN 'outside the root' END"
ROI_FAULT = """CASE WHEN rt IS NULL OR rt = 'NULL' THEN NULL WHEN rt <> 'ARRAY' OR len(list_filter(roi, lambda e: json_type(e) <> 'UBIGINT')) > 0 THEN 'roi is not four numbers'
 WHEN len(roi) <> 4 OR roi[3]::INT <= 0 OR roi[4]::INT <= 0 THEN 'roi out of range' END"""
CATEGORY_FAULT = "CASE WHEN coalesce(trim(clsname), '') = '' THEN 'blank category' WHEN trim(clsname) IN ('.', '..') OR contains(clsname, '/') THEN 'category is not one path component' END"
LABEL_FAULT = "CASE WHEN lt IS NULL OR lt = 'NULL' THEN NULL WHEN lt NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'label is not a number' WHEN coalesce(label NOT IN (0, 1), true) THEN 'label is neither 0 nor 1' END"
SPLIT_FAULT = "CASE WHEN split NOT IN ('train', 'test') THEN 'unknown split' END"
NORMAL_FAULT = "CASE WHEN split = 'train' AND (coalesce(label <> 0, true) OR coalesce(mask, '') <> '') THEN 'not normal and mask-free' END"
AUX_FAULT = "CASE WHEN starts_with({0}, '/') THEN '{0}: absolute path' WHEN starts_with({0}, '../') THEN '{0}: outside the root' END"
MASK_FAULT, FOREGROUND_FAULT = AUX_FAULT.format("mask"), AUX_FAULT.format("foreground")
ALL_FAULTS = f"""faults AS (SELECT ordinal, kind AS rule FROM kinds WHERE kind <> 'record' UNION ALL
 SELECT ordinal, rule FROM (SELECT ordinal, unnest([{PATH_FAULT}, {ROI_FAULT}, {CATEGORY_FAULT}, {SPLIT_FAULT}, {LABEL_FAULT}, {NORMAL_FAULT}, {MASK_FAULT}, {FOREGROUND_FAULT}]) AS rule FROM fold) WHERE rule IS NOT NULL)"""
CLEAN = "clean AS (SELECT *, array_to_string(f, '/') AS rel FROM fold WHERE ordinal NOT IN (SELECT ordinal FROM faults))"
STEM = r"regexp_replace(rel, '\.[^./]*$', '')"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.parse(tables.manifest_lines(spark, sf_dir))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.clean(_parsed(spark, sf_dir))


def manifest_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    return m.scan_faults(parsed).withColumn("scan", F.lit("strict")).unionByName(m.scan_faults(parsed, strict=False).withColumn("scan", F.lit("lenient")))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines dealt to five files, written, and read back with their numbers."""
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    lines = tables.manifest_lines(spark, sf_dir).withColumn("part", F.pmod("ordinal", F.lit(5)))
    lines.repartition("part").sortWithinPartitions("part", "ordinal").select("part", "value").write.partitionBy("part").text(path)
    back = m.read_files(spark, path)
    return back.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "line", "ordinal", "value")


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.faults(m.records(_parsed(spark, sf_dir)), m.path_fault("filename"))


def aux_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = m.records(_parsed(spark, sf_dir))
    return m.faults(rec, m.aux_fault("mask")).unionByName(m.faults(rec, m.aux_fault("foreground")))


def roi_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's own ROI against the size of its image."""
    return m.roi_outside(_clean(spark, sf_dir), tables.image_sizes(spark, sf_dir))


def missing_aux_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks and foregrounds that aren't there: of every fourth record."""
    rows = m.records(_parsed(spark, sf_dir))
    found = []
    for field in ("mask", "foreground"):
        present = rows.filter("ordinal % 4 <> 0").select(F.col(field).alias("path")).distinct()
        found.append(m.missing_files(rows, present, field).withColumn("field", F.lit(field)))
    return found[0].unionByName(found[1])


def roi_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.faults(m.records(_parsed(spark, sf_dir)), m.roi_fault())


def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.faults(m.records(_parsed(spark, sf_dir)), m.category_fault())


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.faults(m.records(_parsed(spark, sf_dir)), m.label_fault())


def train_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = m.records(_parsed(spark, sf_dir)).filter("split = 'train'")
    out = [m.faults(train, m.normal_fault(level)).withColumn("level", F.lit(level)) for level in ("builder", "loader", "sample")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.all_faults(_parsed(spark, sf_dir))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("ordinal", m.output_path().alias("path"))


def aux_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("ordinal", m.aux_path("foreground").alias("foreground"), m.aux_path("mask").alias("mask"))


def train_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.training_set(_clean(spark, sf_dir), ROOT)


def test_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.test_set(_clean(spark, sf_dir), ROOT)


def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = m.unified(_clean(spark, sf_dir))
    return u.filter("split = 'train'").unionByName(u.filter("split = 'test'"))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)
    sizes = tables.image_sizes(spark, sf_dir).select("ordinal", "width", "height")
    return m.summary(rows.join(sizes, "ordinal"))


def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("img/NG/"), F.col("ordinal"), F.lit("_NG_scratch_C1_x.jpg"))).otherwise(F.concat(F.lit("NG/img/"), F.col("ordinal"), F.lit("_OK_C1_x.jpg")))
    return tables.image_sizes(spark, sf_dir).withColumn("name", name).select("ordinal", m.archive_path().alias("path"))


def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.duplicate_paths(m.records(_parsed(spark, sf_dir)))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.records(_parsed(spark, sf_dir))
    present = rows.filter("ordinal % 9 <> 0").select(F.col("filename").alias("path")).distinct()
    return m.missing_files(rows, present)


def sample_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.sample_faults(m.records(_parsed(spark, sf_dir)))


def result_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results lack every 10th sample and have the wrong path for every 15th."""
    samples = tables.image_sizes(spark, sf_dir).select("ordinal", F.col("image_path").alias("path"))
    results = samples.filter("ordinal % 10 <> 0").withColumn("path", F.when(F.col("ordinal") % 15 == 5, F.lit("?")).otherwise(F.col("path")))
    return m.misaligned(samples, results)


def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.image_sizes(spark, sf_dir).select("ordinal", m.content_key("image_path", "width", "height").alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_strict, manifest_files, path_rules, roi_rules, category_rules, label_rules, train_normals, manifest_faults, output_paths, aux_paths, train_manifest, test_manifest,
        aux_path_rules, roi_outside, missing_aux_files, manifest_union, dataset_summary, archive_paths, duplicate_paths, missing_files, sample_contract, result_alignment, content_key,
    )
}


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _faults(rule: str) -> str:
    return _with(REC) + f"SELECT ordinal, rule FROM (SELECT ordinal, {rule} AS rule FROM fold) WHERE rule IS NOT NULL"


_OK = _with(REC, ALL_FAULTS, CLEAN)
_AUX = "CASE WHEN coalesce({0}, '') <> '' THEN concat('annotations/{0}/', " + STEM + r", regexp_extract({0}, '(\.[^./]*)$', 1)) END AS {0}"
_IMG = "img AS (SELECT p_partkey AS ordinal, concat('part/', p_partkey, '.png') AS path, p_brand AS clsname, 8 * p_size + 8 AS width, 4 * p_size + 16 AS height FROM part)"
SQL = {
    "manifest_files": _with(REC) + "SELECT (ordinal % 5)::INT AS part, row_number() OVER (PARTITION BY ordinal % 5 ORDER BY ordinal) - 1 AS line, row_number() OVER (ORDER BY ordinal % 5, ordinal) - 1 AS ordinal, value FROM lines",
    "manifest_strict": _with(REC) + "SELECT ordinal, kind AS rule, 'strict' AS scan FROM kinds WHERE kind <> 'record' UNION ALL SELECT ordinal, kind, 'lenient' FROM kinds WHERE kind NOT IN ('record', 'blank')",
    "path_rules": _faults(PATH_FAULT),
    "roi_rules": _faults(ROI_FAULT),
    "category_rules": _faults(CATEGORY_FAULT),
    "label_rules": _faults(LABEL_FAULT),
    "aux_path_rules": _with(REC) + f"SELECT ordinal, rule FROM (SELECT ordinal, unnest([{MASK_FAULT}, {FOREGROUND_FAULT}]) AS rule FROM rec) WHERE rule IS NOT NULL",
    "roi_outside": _with(REC, ALL_FAULTS, CLEAN, _IMG) + "SELECT ordinal, 'roi exceeds the image' AS rule FROM clean JOIN img USING (ordinal) WHERE roi[1]::INT + roi[3]::INT > width OR roi[2]::INT + roi[4]::INT > height",
    "missing_aux_files": _with(REC) + """SELECT ordinal, mask AS path, 'mask' AS field FROM rec WHERE mask <> '' AND mask NOT IN (SELECT mask FROM rec WHERE ordinal % 4 <> 0 AND mask IS NOT NULL)
UNION ALL SELECT ordinal, foreground, 'foreground' FROM rec WHERE foreground <> '' AND foreground NOT IN (SELECT foreground FROM rec WHERE ordinal % 4 <> 0 AND foreground IS NOT NULL)""",
    "train_normals": _with(REC)
    + """SELECT ordinal, 'not normal and mask-free' AS rule, 'builder' AS level FROM fold WHERE split = 'train' AND (coalesce(label <> 0, true) OR coalesce(mask, '') <> '')
UNION ALL SELECT ordinal, 'not normal and mask-free', 'loader' FROM fold WHERE split = 'train' AND (coalesce(label <> 0, true) OR mask IS NOT NULL)
UNION ALL SELECT ordinal, 'not normal', 'sample' FROM fold WHERE split = 'train' AND NOT coalesce(label = 0, lt IS NULL OR lt = 'NULL')""",
    "manifest_faults": _with(REC, ALL_FAULTS) + "SELECT ordinal, rule FROM faults",
    "output_paths": _OK + "SELECT ordinal, concat('images/', split, '/', trim(clsname), '/', rel) AS path FROM clean",
    "aux_paths": _OK + f"SELECT ordinal, {_AUX.format('foreground')}, {_AUX.format('mask')} FROM clean",
    "train_manifest": _OK + f"SELECT ordinal, concat('{ROOT}/', filename) AS image_path, trim(clsname) AS clsname, label, CASE WHEN foreground <> '' THEN concat('{ROOT}/', foreground) END AS foreground FROM clean WHERE split = 'train'",
    "test_manifest": _OK + f"SELECT ordinal, concat('{ROOT}/', filename) AS image_path, trim(clsname) AS clsname, label, CASE WHEN mask <> '' THEN concat('{ROOT}/', mask) END AS mask, CASE WHEN foreground <> '' THEN concat('{ROOT}/', foreground) END AS foreground FROM clean WHERE split = 'test'",
    "manifest_union": _OK + f"SELECT ordinal, split, concat('images/', split, '/', trim(clsname), '/', rel) AS filename, {_AUX.format('foreground')}, {_AUX.format('mask')}, trim(clsname) AS clsname, label, label_name FROM clean",
    "dataset_summary": _with(REC, ALL_FAULTS, CLEAN, _IMG)
    + """, c AS (SELECT clean.*, img.width, img.height FROM clean JOIN img USING (ordinal))
SELECT count(*) FILTER (split = 'train')::BIGINT AS n_train, count(*) FILTER (split = 'test')::BIGINT AS n_test, string_agg(DISTINCT trim(clsname), ',' ORDER BY trim(clsname)) AS categories,
 (SELECT string_agg(concat(width, 'x', height), ',' ORDER BY width, height) FROM (SELECT DISTINCT width, height FROM c)) AS sizes FROM c""",
    "archive_paths": _with(_IMG) + "SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN concat(clsname, '/NG/scratch/S', ordinal, '/', ordinal, '_NG_scratch_C1_x.jpg') ELSE concat(clsname, '/OK/S', ordinal, '/', ordinal, '_OK_C1_x.jpg') END AS path FROM img",
    "duplicate_paths": _with(REC) + "SELECT array_to_string(f, '/') AS path, count(*)::BIGINT AS n FROM fold GROUP BY 1 HAVING count(*) > 1",
    "missing_files": _with(REC) + "SELECT ordinal, filename AS path FROM rec WHERE filename NOT IN (SELECT filename FROM rec WHERE ordinal % 9 <> 0)",
    "sample_contract": _with(REC) + "SELECT ordinal, 'blank category' AS rule FROM rec WHERE coalesce(trim(clsname), '') = '' UNION ALL SELECT ordinal, 'path occurs twice' FROM (SELECT ordinal, count(*) OVER (PARTITION BY filename) AS n FROM rec) WHERE n > 1",
    "result_alignment": _with(_IMG) + "SELECT ordinal, path, 'sample' AS side FROM img WHERE ordinal % 10 = 0 OR ordinal % 15 = 5 UNION ALL SELECT ordinal, '?', 'result' FROM img WHERE ordinal % 10 <> 0 AND ordinal % 15 = 5",
    "content_key": _with(_IMG) + "SELECT ordinal, sha256(concat(path, '|', width, '|', height)) AS key FROM img",
}
