"""Image manifests: strict JSON lines, record rules as violation tables, splits and paths.

Rules return the rows that break them (``ordinal, rule``); ``require_empty`` turns any
into an error that names a few. A whole manifest is judged before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

IMAGE_CATEGORY = "default"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, ordinal, value`` of the manifest files below a path, blank lines included.

    Lines count from 0 within their file, ordinals over all files in the order of their paths.
    Spark reads a file in blocks, in any order; a block's lines follow those of the blocks
    before it, which are counted first. One row per block is ordered in one task.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    own = ["file", "block"]
    before = W.orderBy(*own).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    starts = lines.groupBy(*own).agg(F.count("*").alias("n"), F.min("id").alias("first")).select(*own, "first", sums(before).alias("all_before"), sums(inside).alias("file_before"))
    place = F.col("id") - F.col("first")
    return lines.join(starts, own).select("file", (F.col("file_before") + place).alias("line"), (F.col("all_before") + place).alias("ordinal"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, value`` of a manifest, of one file or several."""
    return read_files(spark, path).select("ordinal", "value")


def require_records(parsed: DataFrame) -> DataFrame:
    """The manifest itself; one without a single record is an error."""
    if records(parsed).isEmpty():
        raise ValueError("the manifest has no records")
    return parsed


def is_number(variant_type: Column) -> Column:
    return variant_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def whole(number: Column) -> Column:
    """The number if it is a whole one: 1.0 is 1, 0.5 is null."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


def stripped(text: str | Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def parse(lines: DataFrame) -> DataFrame:
    """Typed records: ``kind`` is record, blank, invalid or not an object.

    JSON types are read before values: a boolean label is not the number 1.
    """
    # a one-row generator keeps the optimizer from copying the parse into every field
    v = lines.select("ordinal", "value", F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    kind = (
        F.when(stripped("value") == "", "blank")
        .when(F.col("v").isNull(), "invalid")
        .when(F.schema_of_variant("v").startswith("OBJECT"), "record")
        .otherwise("not an object")
    )
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    type_of = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    typed = v.withColumn("kind", kind).withColumn("v", F.when(F.col("kind") == "record", F.col("v")))
    fields = typed.select(
        "ordinal", "value", "kind", *[text(k) for k in ("filename", "split", "clsname", "label_name", "mask", "foreground")],
        type_of("label").alias("label_type"),
        F.when(is_number(type_of("label")), whole(F.try_variant_get("v", "$.label", "double"))).alias("label"),
        type_of("roi").alias("roi_type"),
        F.when(type_of("roi") == "ARRAY<BIGINT>", F.try_variant_get("v", "$.roi", "array<int>")).alias("roi"),
    )
    return fields.select(F.inline(F.array(F.struct(*fields.columns))))


def scan_faults(parsed: DataFrame, strict: bool = True) -> DataFrame:
    """Lines that are no records; a lenient scan lets blank ones pass."""
    bad = parsed.filter(F.col("kind") != "record")
    return (bad if strict else bad.filter(F.col("kind") != "blank")).select("ordinal", F.col("kind").alias("rule"))


def records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") == "record")


def folded(path: Column) -> Column:
    """Path components after folding ``.`` and ``..``; a leading ``..`` stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when((p == "..") & F.coalesce(F.try_element_at(done, F.lit(-1)) != "..", F.lit(False)), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def path_fault(column: str) -> Column:
    """Why a path is not a relative one strictly inside its root; null if it is."""
    p = F.col(column)
    parts = folded(p)
    return F.when(p.isNull() | (stripped(p) == ""), "empty path").when(p.startswith("/"), "absolute path").when((F.size(parts) == 0) | (F.get(parts, F.lit(0)) == ".."), "outside the root")


def aux_fault(field: str) -> Column:
    """Why an auxiliary path, where there is one, is not inside the root."""
    return F.when(F.coalesce(F.col(field), F.lit("")) != "", F.concat(F.lit(f"{field}: "), path_fault(field)))


def roi_outside(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records whose own ROI exceeds their image (``ordinal, width, height``): ``ordinal, rule``."""
    right = F.get("roi", F.lit(0)).cast("long") + F.get("roi", F.lit(2))
    bottom = F.get("roi", F.lit(1)).cast("long") + F.get("roi", F.lit(3))
    both = rows.filter("roi IS NOT NULL").join(sizes.select("ordinal", "width", "height"), "ordinal")
    return both.filter((right > F.col("width")) | (bottom > F.col("height"))).select("ordinal", F.lit("roi exceeds the image").alias("rule"))


def roi_fault() -> Column:
    """null, or four whole numbers with x, y >= 0 and w, h > 0."""
    r, t = F.col("roi"), F.col("roi_type")
    ok = (F.size(r) == 4) & (F.get(r, F.lit(0)) >= 0) & (F.get(r, F.lit(1)) >= 0) & (F.get(r, F.lit(2)) > 0) & (F.get(r, F.lit(3)) > 0)
    return F.when(t.isNull() | (t == "VOID"), F.lit(None).cast("string")).when(t != "ARRAY<BIGINT>", "roi is not four numbers").when(~ok, "roi out of range")


def category_fault() -> Column:
    c = stripped("clsname")
    return F.when(c.isNull() | (c == ""), "blank category").when(c.isin(".", "..") | c.rlike(r"[/\\]"), "category is not one path component")


def label_fault() -> Column:
    t = F.col("label_type")
    return F.when(t.isNull() | (t == "VOID"), F.lit(None).cast("string")).when(~F.coalesce(is_number(t), F.lit(False)), "label is not a number").when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label is neither 0 nor 1")


def split_fault() -> Column:
    return F.when(~F.coalesce(F.col("split").isin("train", "test"), F.lit(False)), "unknown split")


def normal_fault(level: str = "builder") -> Column:
    """Training records are normal and have no mask.

    builder: label 0, mask falsy; loader: label 0, mask absent; sample: label 0 or absent.
    """
    label = F.col("label") == 0
    if level == "sample":
        return F.when(~F.coalesce(label, F.col("label_type").isNull() | (F.col("label_type") == "VOID")), "not normal")
    masked = F.coalesce(F.col("mask"), F.lit("")) != "" if level == "builder" else F.col("mask").isNotNull()
    return F.when(~F.coalesce(label, F.lit(False)) | masked, "not normal and mask-free")


def faults(rows: DataFrame, fault: Column) -> DataFrame:
    return rows.select("ordinal", fault.alias("rule")).filter("rule IS NOT NULL")


def all_faults(parsed: DataFrame) -> DataFrame:
    """Every broken rule of every line."""
    rec = records(parsed)
    rules = F.array(path_fault("filename"), roi_fault(), category_fault(), split_fault(), label_fault(), F.when(F.col("split") == "train", normal_fault()), aux_fault("mask"), aux_fault("foreground"))
    return scan_faults(parsed).unionByName(rec.select("ordinal", F.explode(F.array_compact(rules)).alias("rule")))


def require_empty(violations: DataFrame, what: str) -> None:
    found = violations.orderBy("ordinal").take(5)
    if found:
        raise ValueError(f"{what}: " + "; ".join(f"line {r['ordinal']}: {r['rule']}" for r in found))


def clean(parsed: DataFrame) -> DataFrame:
    """Records that break no rule."""
    return records(parsed).join(all_faults(parsed).select("ordinal").distinct(), "ordinal", "left_anti")


def output_path() -> Column:
    """``images/{split}/{clsname}/{path}``."""
    return F.concat_ws("/", F.lit("images"), F.col("split"), stripped("clsname"), F.array_join(folded(F.col("filename")), "/"))


def aux_path(field: str) -> Column:
    """``annotations/{field}/{path}`` with the auxiliary file's own suffix; null without one."""
    suffix = F.regexp_extract(F.col(field), r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(F.array_join(folded(F.col("filename")), "/"), r"\.[^./]*$", "")
    return F.when(F.coalesce(F.col(field), F.lit("")) != "", F.concat(F.lit(f"annotations/{field}/"), stem, suffix))


def unified(rows: DataFrame) -> DataFrame:
    """Records as both splits' manifests hold them."""
    return rows.select("ordinal", "split", output_path().alias("filename"), aux_path("foreground").alias("foreground"), aux_path("mask").alias("mask"), stripped("clsname").alias("clsname"), "label", "label_name")


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split, also for one without rows; nulls are written."""
    for split in ("train", "test"):
        part = rows.filter(F.col("split") == split).sort("ordinal").drop("ordinal", "split")
        part.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/split={split}")


def training_set(rows: DataFrame, root: str) -> DataFrame:
    """Normal training records with resolved paths."""
    train = rows.filter("split = 'train'")
    return train.select("ordinal", F.concat_ws("/", F.lit(root), "filename").alias("image_path"), stripped("clsname").alias("clsname"), "label", F.when(F.coalesce("foreground", F.lit("")) != "", F.concat_ws("/", F.lit(root), "foreground")).alias("foreground"))


def test_set(rows: DataFrame, root: str) -> DataFrame:
    test = rows.filter("split = 'test'")
    joined = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws("/", F.lit(root), c)).alias(c)
    name = F.coalesce(F.nullif(stripped("clsname"), F.lit("")), F.lit(IMAGE_CATEGORY))
    return test.select("ordinal", F.concat_ws("/", F.lit(root), "filename").alias("image_path"), name.alias("clsname"), "label", joined("mask"), joined("foreground"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts per split, sorted categories, sorted image sizes."""
    return rows.agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.array_join(F.array_sort(F.collect_set(stripped("clsname"))), ",").alias("categories"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("width", "height"))), lambda s: F.concat_ws("x", s["width"].cast("string"), s["height"].cast("string"))), ",").alias("sizes"),
    )


def duplicate_paths(rows: DataFrame, path: str = "filename") -> DataFrame:
    """Paths (after folding) that occur more than once."""
    return rows.groupBy(F.array_join(folded(F.col(path)), "/").alias("path")).agg(F.count("*").alias("n")).filter("n > 1")


def missing_files(rows: DataFrame, present: DataFrame, path: str = "filename") -> DataFrame:
    """Records whose file is not among ``present`` (column ``path``); ones without a file need none."""
    named = rows.select("ordinal", F.col(path).alias("path"))
    wanted = named if path == "filename" else named.filter("coalesce(path, '') <> ''")
    return wanted.join(present.select("path"), "path", "left_anti")


def sample_faults(rows: DataFrame) -> DataFrame:
    """Inference samples need a category and paths of their own."""
    twice = rows.groupBy("filename").agg(F.count("*").alias("n")).filter("n > 1").select("filename")
    blank = rows.filter(F.coalesce(stripped("clsname"), F.lit("")) == "").select("ordinal", F.lit("blank category").alias("rule"))
    return blank.unionByName(rows.join(twice, "filename", "left_semi").select("ordinal", F.lit("path occurs twice").alias("rule")))


def misaligned(samples: DataFrame, results: DataFrame) -> DataFrame:
    """(ordinal, path) pairs that only one side has."""
    keys = ["ordinal", "path"]
    left = samples.select(*keys).join(results.select(*keys), keys, "left_anti").withColumn("side", F.lit("sample"))
    right = results.select(*keys).join(samples.select(*keys), keys, "left_anti").withColumn("side", F.lit("result"))
    return left.unionByName(right)


def archive_path(name: str = "name", category: str = "clsname") -> Column:
    """Place of an image in its archive, told by its base name from the right.

    Faulty images: category/label/defect/S{sample}/base; good ones: category/label/S{sample}/base.
    """
    base = F.element_at(F.split(F.col(name), "/"), -1)
    parts = F.split(base, "_")
    of = lambda k: F.try_element_at(parts, F.lit(k))
    faulty = F.concat_ws("/", F.col(category), of(-4), of(-3), F.concat(F.lit("S"), of(-5)), base)
    good = F.concat_ws("/", F.col(category), of(-3), F.concat(F.lit("S"), of(-4)), base)
    return F.when(F.contains(base, F.lit("NG")), faulty).otherwise(good)


def content_key(*columns: str) -> Column:
    """Cache key of a file version."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
