"""Scratch tables belong to the call, or the block, that wrote them."""

import os

import pytest

import corpus_pipeline as C
from parity.llm import _base as B
from parity.llm.exact_dedup import op1_exact_dedup


def tables(spark):
    return set(os.listdir(B.scratch_dir(spark).removeprefix("file://")))


def test_a_pipeline_leaves_the_tables_of_others(spark, sf_dir):
    mine = op1_exact_dedup(spark, sf_dir)
    n = mine.count()
    C.run(spark, sf_dir).count()
    assert mine.count() == n


def test_a_block_deletes_what_was_written_in_it_and_nothing_else(spark):
    kept = B.materialize(spark.range(5).toDF("x"))
    before = tables(spark)
    with pytest.raises(ZeroDivisionError):
        with B.owned(spark):
            with B.owned(spark):
                assert B.materialize(spark.range(3).toDF("x")).count() == 3
            assert tables(spark) == before
            B.materialize(spark.range(4).toDF("x"))
            raise ZeroDivisionError
    assert tables(spark) == before and kept.count() == 5


def test_components_keep_one_table(spark):
    before = tables(spark)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    found = B.connected_components(edges)
    assert len(tables(spark) - before) == 1 and {r.root for r in found.collect()} == {0}
    with B.owned(spark):
        assert B.connected_components(edges).count() == 41
    assert len(tables(spark) - before) == 1


def test_a_cluster_must_name_a_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        B.scratch_dir(Session())
