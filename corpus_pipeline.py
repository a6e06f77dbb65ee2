"""A training corpus from raw documents: five operators, each on all that its predecessor kept.

The stages take (spark, docs, sf_dir); every one is written as Parquet and read
again as the next one's documents. All but the last return the columns of
``documents``. Near copies are proposed by SimHash fingerprints and their distance
tables and taken at a similarity of 0.8 over five-word shingles; the copy with the
least doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import drop, stage
from lumenfold.llm.curve_packing import pack
from lumenfold.llm.fm_dedup import without_repeats
from lumenfold.llm.knn_quality import accepted
from lumenfold.llm.pivot_simhash import without_copies
from lumenfold.llm.spaced_seeds import clean_documents


# Each stage's operator states in its docstring what nulls, ties, repeated rows and empty tables give;
# rows are told by doc_id and text together, so one of several texts under a doc_id never decides for another.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("curve_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs, written = stage(step(spark, docs, sf_dir), name)
        if path:  # a stage's input goes when its output is written
            drop(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier votes, suffix orders and the packing curve have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
