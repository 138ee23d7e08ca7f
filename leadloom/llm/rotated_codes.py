"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector minus the centre is padded with zeros to at least ``BITS`` dimensions (more bits, a smaller error), rotated by a
random orthogonal matrix and kept as one sign bit per dimension, with two scalars: its length and its inner product with
its own code. Packed bits and scalars give an estimate of the distance to a rotated query and a bound of its error; all
vectors whose lower bound is not beyond the k-th upper bound are reranked with the original vectors in double precision.

Only the centre is fitted on a bounded sample; every row is indexed. Equal vectors are one entry of the index, which
knows its ``k + 1`` smallest ids (more can't be among the nearest). The index lies in chunks, the queries in blocks;
each task compares one chunk with one block and returns the candidates, so neither side has to fit into one task and
neither is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.llm.common import keep

K = 10
#: Vectors from which the centre is taken, the first in the order of a hash.
SAMPLE = 20_000
#: Bits of a code; vectors of more dimensions have one bit for each.
BITS = 512
#: Error bounds as a multiple of the estimate's standard deviation.
WIDTH = 2.0
CHUNK, BLOCK = 32_768, 1_024
SEED = 17
_DIRECTIONS = "entry bigint, bits binary, length double, own double"


def taking_part(vector: str | Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def rotation(dimensions: int, bits: int | None = None, seed: int = SEED) -> np.ndarray:
    """The rows of a random rotation in ``bits`` dimensions that act on the first ``dimensions`` of them."""
    bits = bits or dimensions
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimensions]


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimensions)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _codes(batches: Iterator[pa.RecordBatch], centre: np.ndarray, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turned = (_matrix(batch.column(1), len(centre)) - centre) @ turn
        length = np.sqrt((turned**2).sum(1))
        own = np.abs(turned).sum(1) / np.sqrt(turned.shape[1]) / np.where(length > 0, length, 1)
        bits = np.packbits(turned > 0, axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _binary(bits), pa.array(length), pa.array(np.where(length > 0, own, 1.0))],
            names=["entry", "bits", "length", "own"],
        )


def _turned(batches: Iterator[pa.RecordBatch], centre: np.ndarray, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turned = (_matrix(batch.column(1), len(centre)) - centre) @ turn
        yield pa.RecordBatch.from_arrays([batch.column(0), _binary(turned)], names=["query_id", "turned"])


def _bounds(batches: Iterator[pa.RecordBatch], bits: int, k: int, width: float) -> Iterator[pa.RecordBatch]:
    """Candidates of each query of a block within one chunk, with the lower and upper bounds of their squared distances."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].values for j, name in enumerate(batch.schema.names)}
            entries, queries = np.asarray(row["entries"]), np.asarray(row["queries"])
            packed = np.frombuffer(b"".join(row["bits"].to_pylist()), np.uint8).reshape(len(entries), -1)
            signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
            turned = np.frombuffer(b"".join(row["turned"].to_pylist()), np.float64).reshape(-1, bits)
            length, own = np.asarray(row["length"]), np.asarray(row["own"])
            spread = np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(bits - 1, 1))
            found: list[tuple[np.ndarray, ...]] = []
            for query, q in zip(queries, turned):
                size = np.sqrt(q @ q)
                inner = (signs @ q.astype(np.float32)).astype(np.float64) / np.sqrt(bits) / own
                middle = length**2 + size**2 - 2 * length * inner
                error = 2 * width * length * size * spread + 1e-5 * (length**2 + size**2)
                upper = middle + error
                # One more than k: the query's own vector may be an entry without another id.
                limit = np.partition(upper, k)[k] if len(upper) > k else np.inf
                near = np.flatnonzero(middle - error <= limit)
                found.append((np.full(len(near), query), entries[near], (middle - error)[near], upper[near]))
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "entry", "lower", "upper"])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: float = WIDTH,
    sample: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank (from 1), vec_id, score`` (Euclidean): the ``k`` nearest found of each row that ``is_query`` names.

    Candidates are all rows but the query's own id; ties go to the smaller id. Vectors that are null, zero, or hold null
    or non-finite components take no part, nor do rows without an id or of another than the most frequent dimension.
    Rows repeated with id and vector count once. Empty input gives no rows; other columns are ignored.
    """
    valid = vectors.where(F.col(id_col).isNotNull() & taking_part(vector_col)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("asked")
    )
    sizes = valid.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dimensions = sizes[0]["d"] if sizes else 1
    valid = valid.where(F.size("vector") == dimensions)
    picked = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow().column("vector")
    centre = _matrix(picked.combine_chunks(), dimensions).mean(0) if len(picked) else np.zeros(dimensions)
    bits = max(BITS, -(-dimensions // 8) * 8)
    turn = rotation(dimensions, bits)

    by_vector = W.partitionBy("vector").orderBy("vec_id")
    distinct = valid.groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    first_ids = distinct.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    entries = keep(
        first_ids.groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
        .select(F.element_at("members", 1).alias("entry"), "vector", "members"),
        "vector-entries",
    )
    # Vectors with one id may share it; the entry's number has to be its own.
    entries = keep(
        entries.withColumn("entry", F.monotonically_increasing_id()),
        "numbered-entries",
    )
    queries = keep(
        valid.where("asked").groupBy("vec_id", "vector").agg(F.count("*").alias("n")).select(F.col("vec_id").alias("query_id"), "vector"),
        "vector-queries",
    )
    chunks, blocks = (max(1, -(-df.count() // size)) for df, size in ((entries, CHUNK), (queries, BLOCK)))
    codes = entries.select("entry", "vector").mapInArrow(lambda b: _codes(b, centre, turn), _DIRECTIONS)
    index = (
        codes.groupBy(F.pmod(F.xxhash64("entry"), F.lit(chunks)).alias("chunk"))
        .agg(F.collect_list(F.struct("entry", "bits", "length", "own")).alias("c"))
        .select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
            F.col("c.entry").alias("entries"),
            "c.bits",
            "c.length",
            "c.own",
        )
    )
    asked = queries.mapInArrow(lambda b: _turned(b, centre, turn), "query_id bigint, turned binary")
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("query_id", "turned")).alias("q")
    )
    met = index.join(asked.select("block", F.col("q.query_id").alias("queries"), "q.turned"), "block").drop("block")
    bounds = keep(
        met.mapInArrow(
            lambda b: _bounds(b, bits, k, width), "query_id bigint, entry bigint, lower double, upper double"
        ),
        "candidates",
    )
    by_upper = W.partitionBy("query_id").orderBy("upper")
    limits = (
        bounds.select("query_id", "upper")
        .withColumn("place", F.row_number().over(by_upper))
        .where(F.col("place") <= k + 1)
        .groupBy("query_id")
        .agg(F.max("upper").alias("limit"))
    )
    near = bounds.join(limits, "query_id").where("lower <= limit").select("query_id", "entry")
    scored = (
        near.join(entries, "entry")
        .join(queries.withColumnRenamed("vector", "__query"), "query_id")
        .select("query_id", "members", euclidean(F.col("__query"), F.col("vector")).alias("score"))
        .select("query_id", "score", F.explode("members").alias("vec_id"))
        .where("vec_id <> query_id")
    )
    # An id with several vectors counts with its nearest.
    best = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
