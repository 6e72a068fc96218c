"""A corpus from raw documents to packed sequences, as stages that each read what the one before wrote.

Each stage takes (spark, docs, sf_dir) and works on all of ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, lines, minhash, packing, quality
from millrace.llm._work import discard, stored

#: Words in a shingle and the similarity, in percent, from which documents are near copies.
SHINGLE, PERCENT = 5, 80
#: Lines of 16 characters or more are near copies within one edit, or 1 % of the longer one's characters, three at most.
LINE_THRESHOLD = lines.Threshold(edits=1, percent=1, most=3)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` true of the texts as they are now, if there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near copies of an earlier one, as ``LINE_THRESHOLD`` says, go; so do documents without any other line."""
    return _counted(lines.deduplicate(docs, threshold=LINE_THRESHOLD))


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.deduplicate(docs, shingle=SHINGLE, percent=PERCENT)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; other benchmark passages are cut out."""
    return _counted(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", deduplicate_lines),
    ("minhash_near_dedup", deduplicate_documents),
    ("benchmark_decontamination", remove_benchmarks),
    ("packing", pack_sequences),
]

#: No stage but the last could be SQL: trained rules, edit joins and signatures are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
