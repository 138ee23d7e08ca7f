"""The training-data pipeline: stages of the operators in ``leadloom.llm``, each written as Parquet and read again."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from leadloom.llm import exact_dedup, mixing, order_minhash, packing, toxicity  # noqa: E402
from leadloom.llm.common import DOCUMENT_COLUMNS, read_documents, shared_folder  # noqa: E402
from leadloom.llm.queries import tokenizer_path  # noqa: E402


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs.select(*DOCUMENT_COLUMNS))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", one_of_equal_texts),
    ("near_dedup", one_of_near_copies),
    ("mix_sources", mixed_sources),
    ("packing", packed),
]

#: SQL can't express toxicity, near-duplicates and packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
