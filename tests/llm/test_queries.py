"""Registered queries of the operators, against their SQL where there is some."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import compare, connect, entry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.queries()) - entry.LIBRARY)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), SF, name)
    assert ok, note


def test_all_are_registered():
    assert {n.split("_")[0] for n in NAMES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] > left[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == left[-1]
