"""A corpus pipeline over ``documents`` made of the llm operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``, extra ones included.  No SQL states the rows of
run(): rank-order language profiles, MinHash links over 64-bit hashes, SimHash windows and
seeded rounding have none.  tests/llm/test_pipeline.py compares what run() returns with the
stages applied by hand, and each stage's decisions with plain models.

Rows with a null doc_id pass every stage that their text passes: no stage finds them a copy of
another row, and none takes them for one.  Rows that share a doc_id are judged together where
a stage decides by doc_id (near_dedup, decontaminate).  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, langid, linechunks, minhash, mixing
from palimpsest.llm.shared import drop, keep

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or out of place in every learned
    language, go.  Languages are learned from rows with a lang and a text; without any, all go.
    Repeated rows are judged alike.
    """
    profiles = langid.learn_profiles(docs.select("doc_id", "text", "lang"))
    return langid.accepted(docs, profiles)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, and documents of which nothing else is left.  Null, empty and
    blank texts lose nothing and stay; n_chars, where there is one, counts what is left.
    """
    out = linechunks.line_dedup(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    out = out.where(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest doc_id: five-word shingles,
    similarity 0.8.  Null, empty and blank texts are nobody's copies; repeated rows of the
    document that stays all stay.
    """
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: a window of at least 0.8 weighted similarity.  Null
    or blank texts and items match nothing; an empty benchmark lets all documents stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the copies that the mix takes of it; documents it leaves out go, and texts
    without words, of which nothing can be taken.  A null source is one; repeated rows are drawn
    each for itself.
    """
    return mixing.apply_mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Each stage's table goes as soon as the next one is written; the
    last is read by the result and stays until shared.sweep()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
