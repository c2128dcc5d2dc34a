import pytest

import corpus_pipeline
import __spark_entry__ as entry
from acqlens.llm import queries
from acqlens.llm.oracles import ORACLES
from tests.llm.helpers import awkward, frame
from tools.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secret_scan", "mix", "pack"]
    docs = frame(spark, awkward()).unionByName(spark.read.parquet(SMALL + "/documents.parquet").limit(40), allowMissingColumns=True)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
            assert stage(spark, docs.limit(0), SMALL).columns == columns
        docs = out
    assert docs.count() > 30


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    assert corpus_pipeline.language(spark, docs, SMALL).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_agreement(spark, name):
    status, message = compare(spark, connect(SMALL), SMALL, name, queries.QUERIES[name], ORACLES[name])
    assert status == "OK", message
