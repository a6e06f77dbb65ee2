import re
import time
from pathlib import Path

import corpus_pipeline
import pytest
from lumenfold.llm import common
from lumenfold.llm.queries import oracle_sql, queries
from pyspark.sql import functions as F


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, sf), name)[0]
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_stages_leave_only_what_their_results_read(spark, docs, sf):
    """The next stage's disk holds no table that the stage before it staged for itself, and the results are whole."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    for step, left in ((corpus_pipeline.near_dedup, "kept"), (corpus_pipeline.substring_dedup, "spans")):
        before = {p.name for p in folder.iterdir()} if folder.exists() else set()
        rows = step(spark, docs, sf)
        assert [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before] == [left]
        assert rows.count() > 40


def test_tables_of_a_failed_step_go(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def fails():
        common.stage(spark.range(3), "half")
        raise ValueError("half way")

    with pytest.raises(ValueError, match="half way"):
        common.stage_alone(spark, fails, "whole")
    assert not list(folder.glob("half-*")) + list(folder.glob("whole-*"))
    inner = lambda: common.stage_alone(spark, lambda: common.stage(spark.range(5), "half")[0], "inner")[0]
    out, _ = common.stage_alone(spark, inner, "whole")
    assert out.count() == 5 and not list(folder.glob("half-*")) + list(folder.glob("inner-*"))


def test_shuffles_of_a_step_go_with_it(spark):
    """While the next step runs, the disk holds no shuffle of the step before, though its frame is still there."""
    files = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString()))
    setting, seen = spark.conf.get(common.SHUFFLES_GO, None), {}

    def steps():
        before, rows = files(), spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count()
        out, _ = common.stage(rows, "half")
        until = time.time() + 15
        while (left := files() - before) and time.time() < until:  # Spark deletes them in the background
            time.sleep(0.1)
        seen["left"] = left
        seen["twice"] = [sorted(map(tuple, rows.collect())) for _ in range(2)]
        return out.groupBy("count").agg(F.count("*").alias("n"))

    out, _ = common.stage_alone(spark, steps, "whole")
    assert seen["left"] == set()
    assert seen["twice"] == [[(k, 104 if k < 9 else 103) for k in range(97)]] * 2
    assert sorted(map(tuple, out.collect())) == [(103, 88), (104, 9)]
    assert spark.conf.get(common.SHUFFLES_GO, None) == setting
    spark.conf.set(common.SHUFFLES_GO, "false")
    with pytest.raises(ZeroDivisionError):
        common.stage_alone(spark, lambda: 1 // 0, "whole")
    assert spark.conf.get(common.SHUFFLES_GO) == "false"
    spark.conf.unset(common.SHUFFLES_GO)


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())


def test_stages_take_odd_rows_and_columns(spark, sf, docs, empty):
    for given in (docs, empty):
        at = given
        for name, step in corpus_pipeline.STAGES[:-1]:
            at = corpus_pipeline.stage(step(spark, at, sf), name)[0]
            assert at.columns == given.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in at.collect()}
    first = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 2 OR doc_id = 3 OR doc_id IS NULL"))
    kept = corpus_pipeline.near_dedup(spark, first, sf).collect()
    assert {r.doc_id for r in kept} == {1, None}
