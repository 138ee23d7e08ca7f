"""The pipeline on made documents, stage by stage, and on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from leadloom.llm.common import DOCUMENT_COLUMNS
from leadloom.llm.queries import QUERIES
from tests.llm.test_repeats import plain_removal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_all_operators_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "packing"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.filter("doc_id = 3")
    docs = docs.unionByName(copy.withColumn("doc_id", F.lit(90_000).cast("long"))).unionByName(
        copy.withColumn("doc_id", F.lit(90_001).cast("long")).withColumn("text", F.concat("text", F.lit(" and one more sentence.")))
    )
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(DOCUMENT_COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = [r["doc_id"] for r in docs.collect()]
    assert len(seen["exact_dedup"]) == len(set(seen["exact_dedup"])) and 90_000 not in seen["exact_dedup"]
    assert {3, 90_001} <= set(seen["exact_dedup"]) and 90_001 not in seen["near_dedup"] and 3 in seen["near_dedup"]
    assert set(seen["mix_sources"]) <= set(seen["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert whole.filter("n <> end or n > 2048").count() == 0
    assert packed.filter("piece = 0").count() == len(seen["mix_sources"])


def test_run_gives_packed_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_suffix_dedup_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, plain_removal(list(docs.values()))))
    got = QUERIES["op9_suffix_dedup"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("name", ["op3_toxicity", "op5_near_dedup", "op7_secrets"])
def test_queries_return_a_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r[0] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
