"""The driver's queries over these operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn_quality import score_documents

    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(documents(spark, sf_dir)).drop("detections")


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curve_packing import pack

    return pack(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op4_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .record_files import encode_and_reread

    return encode_and_reread(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spaced_seeds import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_simhash import cluster

    found = cluster(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_dedup import repeated_spans

    return repeated_spans(documents(spark, sf_dir)).drop("spans", "k1", "k2")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import score

    return score(documents(spark, sf_dir))


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(documents(spark, sf_dir)).withColumn("distance2", F.round("distance2", 4))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Operators without SQL rest on XXH64, tokenizers, framed files, hundreds of ranked patterns or trained models; tests hold those against brute force.
PASSAGES = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, ws, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, n - 11)) AS i FROM t WHERE n >= 13)),
f AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT g.doc_id, g.i, unnest(range(13)) AS k FROM g JOIN f ON g.win = f.win WHERE least < g.doc_id)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
k AS (SELECT p.doc_id, count(c.pos) AS gone, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (c.pos IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    from . import quality_sql, seeds_sql

    return {"op5_spaced_seeds": seeds_sql.statement(), "op7_fm_dedup": PASSAGES, "op10_quality_rules": quality_sql.statement()}
