"""The registered queries against their oracles, and the pipeline stage by stage."""

import os
import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from riskloom.llm import queries
from riskloom.sources.shared import write_shared

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, FOLDER).toPandas() for name, query in queries.QUERIES.items()}


def test_one_query_per_operator(results):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in results) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", ["op1_toxicity_scores", "op4_quality_scores"])
def test_scores(results, name):
    import zlib

    got = results[name]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    modulus, rest = (4, 2) if name.startswith("op1") else (5, 0)
    assert all(h == (zlib.crc32(str(i).encode()) % modulus == rest) for i, h in zip(got.doc_id, got.held_out))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_shared(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3] > 0 and counts[4] > 0
    lengths = docs.where("n_chars <> length(text)").count()
    assert lengths == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.where("length < 1").count() == 0
