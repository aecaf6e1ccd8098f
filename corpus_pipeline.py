"""The corpus pipeline: five stages, each a table of documents written and read again.

1. quality classifier: documents that it rejects go.
2. n-gram Jaccard join: one document of each group of near copies stays.
3. suffix-array dedup: strings of PASSAGE bytes that stand elsewhere too are cut from the
   texts.
4. mixing: sources are taken to their target weights, in whole documents; a document
   appears as often as the mix takes it.
5. best-fit packing: the tokenised documents are packed into sequences.

All but the last return the columns of ``documents``; the last returns the pieces.

Defined cases: null and blank texts are judged by the classifier like others, the later
stages keep them as they are; null sources are a source of their own; documents that
repeat an id are documents of their own, and equal texts are one group of near copies, of
which one row stays; very long texts are treated whole; an empty table goes through all
stages and gives no pieces; extra columns, whatever their names, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.llm import mixing, ngram_join, packing, quality_classifier, suffix_dedup
from tilewise.llm.shared import new_path


#: Bytes of a passage that must not repeat: passages of over 50 words are longer, unless
#: their words have fewer than three letters on average.
PASSAGE = 200


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(suffix_dedup.without_repeats(docs, length=PASSAGE)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier is trained and tokenizers are no SQL functions: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
