"""License scans by diagonal voting.

Rolling word pairs of every text are joined to the places of the same pairs in the
license templates. A hit at document word p and template word t votes for the diagonal
p - t; a passage that follows a template piles its votes on one diagonal, or on a few
neighbouring ones where words were put in or left out. Phrases need every vote of one
diagonal (an exact place); longer notices merge diagonals at most MERGE apart and are
verified by the share of template pairs that the merged span covers.

Defined cases: null text has no words; repeated rows each get a row of their own
(rows, not ids, are grouped); null ids are carried; extra columns are ignored; an
empty table gives an empty result. Places may overlap and all count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tilewise.llm import textkernel as tk
from tilewise.llm.shared import pick, stored

K = 2
#: Diagonals of a notice at most so far apart are one span.
MERGE = 4
#: Share of a notice's word pairs that a span must cover.
COVER = 0.6

#: Phrases whose places the contract counts, and their labels.
BASE_PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: The method's own labels: versions and variants, matched exactly.
PHRASES = (
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("bsd", "bsd license"),
    ("mpl", "mozilla public license"),
)
#: Notices, matched with gaps.
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
TEMPLATES = tuple((label, text, kind) for kind, group in (("base", BASE_PHRASES), ("phrase", PHRASES), ("notice", NOTICES)) for label, text in group)


@lru_cache(maxsize=1)
def template_grams() -> list[tuple[int, int, int]]:
    """(hash, template, place) of each word pair of the templates."""
    out = []
    for i, (_, text, _) in enumerate(TEMPLATES):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        _, _, of, h = tk.word_hashes(data, offsets, tk.ALNUM_DELIMS, True)
        at, gram = tk.windows(h, of, K)
        out += [(int(g), i, int(p)) for g, p in zip(gram.astype(np.int64), at, strict=True)]
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: row number, id, word count, and its template pairs with places."""
    known = np.unique(np.array([g for g, _, _ in template_grams()], np.int64))
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        data, offsets = tk.texts_of(b.column(1))
        n_words, grams, places = [], [], []
        for i, j, d, o in tk.runs(data, offsets):
            _, _, of, h = tk.word_hashes(d, o, tk.ALNUM_DELIMS, True)
            count = np.bincount(of, minlength=j - i)
            first = np.concatenate([[0], np.cumsum(count)])
            at, gram = tk.windows(h, of, K)
            gram = gram.astype(np.int64)
            hit = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
            at, gram = at[hit], gram[hit]
            cut = np.searchsorted(at, first)
            n_words.append(count)
            grams += [gram[cut[k] : cut[k + 1]] for k in range(j - i)]
            places += [at[cut[k] : cut[k + 1]] - first[k] for k in range(j - i)]
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + n, dtype=np.int64)),
                b.column(0),
                pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                pa.array(grams, pa.list_(pa.int64())),
                pa.array(places, pa.list_(pa.int64())),
            ],
            ["row", "doc_id", "n_words", "grams", "places"],
        )
        row += n


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = docs.sparkSession
    found = pick(docs, "doc_id", "text").mapInArrow(_grams, "row long, doc_id long, n_words long, grams array<long>, places array<long>")
    rows = stored(found, "license-grams")
    names = spark.createDataFrame([(i, label, kind, len(text.split()) - 1) for i, (label, text, kind) in enumerate(TEMPLATES)], "template int, label string, kind string, n_grams int")
    grams = spark.createDataFrame(template_grams(), "gram long, template int, t int")
    # both tables have the fixed size of the templates above
    hits = (
        rows.select("row", F.explode(F.arrays_zip("grams", "places")).alias("h"))
        .select("row", F.col("h.grams").alias("gram"), F.col("h.places").alias("p"))
        .join(F.broadcast(grams), "gram")
        .join(F.broadcast(names), "template")
        .select("row", "template", "label", "kind", "n_grams", "t", (F.col("p") - F.col("t")).alias("diagonal"))
    )
    votes = hits.groupBy("row", "template", "label", "kind", "n_grams", "diagonal").agg(F.collect_set("t").alias("at"))
    exact = votes.filter("kind <> 'notice' AND size(at) = n_grams").select("row", "label", "kind", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    chained = votes.filter("kind = 'notice'").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= MERGE, 0).otherwise(1))
    spans = (
        chained.withColumn("span", F.sum("new").over(along))
        .groupBy("row", "template", "label", "kind", "n_grams", "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_at"), F.min("diagonal").alias("start"))
        .withColumn("cover", F.col("n_at") / F.col("n_grams"))
        .filter(F.col("cover") >= COVER)
        .select("row", "label", "kind", "start", "cover")
    )
    base = F.col("kind") == "base"
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    per_row = exact.unionByName(spans).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    return rows.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same scan in DuckDB SQL, on words instead of hashes."""
    values = ", ".join(
        f"({i}, '{label}', '{kind}', {len(words) - 1}, '{a} {b}', {t})" for i, (label, text, kind) in enumerate(TEMPLATES) for words in [text.split()] for t, (a, b) in enumerate(zip(words, words[1:], strict=False))
    )
    return f"""
WITH templates(template, label, kind, n_grams, gram, t) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT r, unnest(range(0, greatest(len(w) - 1, 0))) AS p, w FROM d),
hits AS (SELECT r, template, label, kind, n_grams, t, p - t AS diagonal FROM (SELECT r, p, w[p + 1] || ' ' || w[p + 2] AS gram FROM g) x JOIN templates USING (gram)),
votes AS (SELECT r, template, label, kind, n_grams, diagonal, list(DISTINCT t) AS places FROM hits GROUP BY ALL),
exact AS (SELECT r, label, kind, diagonal AS start, 1.0::DOUBLE AS cover FROM votes WHERE kind <> 'notice' AND len(places) = n_grams),
chained AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {MERGE} THEN 0 ELSE 1 END AS new FROM votes WHERE kind = 'notice'),
spanned AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM chained),
spans AS (SELECT r, label, kind, min(diagonal) AS start, len(list_distinct(flatten(list(places))))::DOUBLE / n_grams AS cover FROM spanned GROUP BY r, template, label, kind, n_grams, span),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM spans WHERE cover >= {COVER}),
per AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN per USING (r)
"""
