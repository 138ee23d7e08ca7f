"""Exact dedup, mixing and URL filters: SQL twins on the smallest tables, and odd rows by hand."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import exact_dedup, mixing, url_filters
from leadloom.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, copy int"


def odd_docs(spark):
    rows = [
        (5, "a  b\tc", "en", "s", 6, "x", 7), (3, "a b c", None, "s", None, "x", 7), (9, "a b c", "en", None, 5, None, 7),
        (4, None, "en", "t", 0, "x", None), (8, "", "en", "t", 0, "x", 7), (None, "a b\nc", "en", "s", 5, "x", 7),
        (6, "alone", "en", "t", 5, "x", 7), (6, "alone", "en", "t", 5, "x", 7), (None, "no id", "en", "t", 5, "x", 7),
        (7, "é" * 50_000, "fr", "long", 50_000, "x", 7), (2, "A b c", "en", "s", 5, "x", 7),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_exact_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = exact_dedup.exact_dedup(docs).collect()
    rows = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r["doc_id"])
    want = sorted(
        (
            repr(r["doc_id"]),
            repr(min((i for i in groups[norm(r["text"])] if i is not None), default=None)),
            len(groups[norm(r["text"])]),
            hashlib.sha256(norm(r["text"]).encode()).hexdigest(),
        )
        for r in rows
    )
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [3, 4, 6, None, 7, 2]))
    empty = docs.limit(0)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    docs = spark.range(3_000).select(
        (F.lit(5_000) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact_dedup.exact_dedup(docs, salts=4)
    assert got.filter("group_size = 1000 and keep_id = 2003").count() == 1_000
    assert got.filter("kept").count() == 2_001


def test_poisson_steps_invert_the_distribution(spark):
    import math

    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate))).first()[0]
        total, term = 0.0, -rate
        for k, step in enumerate(steps):
            term = term + (math.log(rate) - math.log(k) if k else 0.0)
            total += math.exp(term) if rate else 1.0
            assert step == pytest.approx(total, rel=1e-9)
        assert steps[-1] == pytest.approx(1.0, abs=1e-9)


def test_mixing_meets_its_weights(spark):
    docs = spark.range(6_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(10)).alias("text"),
        F.when(F.col("id") < 4_000, "big").when(F.col("id") < 5_500, "mid").alias("source"),
    )
    mixed = mixing.mix_sources(docs, {"big": 1.0, "mid": 3.0}, budget=2.0)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts["big"] == pytest.approx(3_000, rel=0.06) and counts["mid"] == pytest.approx(9_000, rel=0.06)
    assert None not in counts
    every = mixing.mix_sources(docs)
    assert {r["source"] for r in every.select("source").distinct().collect()} == {"big", "mid", None}
    again = mixing.mix_sources(docs)
    assert sorted(every.select("doc_id", "copy").collect()) == sorted(again.select("doc_id", "copy").collect())
    # Each partition is in the order of the key, which has nothing to do with the source.
    first = every.filter(F.spark_partition_id() == 0).select("shuffle_key").collect()
    assert first == sorted(first)


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix_sources(docs, budget=5.0)
    assert set(docs.columns) - {"copy"} < set(mixed.columns) and dict(mixed.dtypes)["copy"] == "int"
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {}).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_sources(blank).count() == 0


def captures(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, t long, lists string")
    return df.withColumn("fetched_at", F.timestamp_seconds("t"))


def entries(spark, rows):
    df = spark.createDataFrame(rows, "list_name string, domain string, t long, action string")
    return df.withColumn("effective_at", F.timestamp_seconds("t"))


def test_url_filters_follow_the_dates(spark):
    day = 86_400
    listed = entries(
        spark,
        [("bad", "evil.example", 10 * day, "block"), ("bad", "evil.example", 50 * day, "release"),
         ("bad", "evil.example", 50 * day, "block"), ("bad", "evil.example", 90 * day, None),
         ("ads", "SUB.evil.example", 0, "block"), (None, "x.example", 0, "block"), ("bad", None, 0, "block")],
    )
    asked = captures(
        spark,
        [(1, "https://evil.example/a", 10 * day, "z"), (2, "http://a.sub.evil.example:80/", 60 * day, "z"),
         (3, "http://evil.example", 10 * day - 1, "z"), (4, "http://evil.example", 90 * day, "z"),
         (5, "http://notevil.example", 20 * day, "z"), (6, None, 20 * day, "z"), (7, "/relative", 20 * day, "z"),
         (8, "http://evil.example", None, "z"), (9, "http://user@EVIL.example?q", 89 * day, "z"),
         (9, "http://user@EVIL.example?q", 89 * day, "z")],
    )
    got = {r["page_id"]: (r["lists"], r["n_lists"], r["blocked"]) for r in url_filters.filter_urls(asked, listed).collect()}
    assert got == {
        1: ("bad", 1, True), 2: ("ads,bad", 2, True), 3: ("", 0, False), 4: ("", 0, False), 5: ("", 0, False),
        6: ("", 0, False), 7: ("", 0, False), 8: ("", 0, False), 9: ("bad", 1, True),
    }
    assert url_filters.filter_urls(asked, listed.limit(0)).filter("blocked").count() == 0
    assert url_filters.filter_urls(asked.limit(0), listed).count() == 0
