"""Order within a key without putting the whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def range_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], partitions: int | None = None
) -> DataFrame:
    """Range-partitioned and sorted by key and order; a hot key spans several partitions.

    The split points come from sampling, so the placed rows are checkpointed: every later
    reading sees the same partition and row numbers.
    """
    spark = df.sparkSession
    n = max(min(partitions or 1_000_000, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(n, *keys, *order_cols)
        .sortWithinPartitions(*keys, *order_cols)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("__part", F.shiftright("__mid", _ROW_BITS))
    return cut_lineage(placed.withColumn("__row", F.col("__mid") - F.shiftleft("__part", _ROW_BITS)).drop("__mid"))


def rank_within_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "position"
) -> DataFrame:
    """``row_number`` per key for a total order, with hot keys spread over partitions.

    Each partition holds a contiguous run of a key. The rank is the row's place in its run
    plus the lengths of the key's earlier runs; those runs are one slim row per key and
    partition.
    """
    placed = range_sorted(df, keys, order)
    runs = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__from"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"__run_{k}") for k in keys],
        F.col("__part").alias("__run_part"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from") + 1).alias("__shift"),
    )
    same = F.col("__part") == F.col("__run_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__run_{k}"))
    return placed.join(runs, same).select(*df.columns, (F.col("__row") + F.col("__shift")).cast("bigint").alias(out))


def blocks_within_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: Column | int,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``__block``: consecutive, ordered pieces of each key of at most ``rows_per_block`` rows.

    Blocks sort like the rows they hold; a block never spans two partitions, so ``partitions``
    should not be more than there are blocks.
    """
    placed = range_sorted(df, keys, order, partitions)
    block = F.struct(F.col("__part"), F.floor(F.col("__row") / rows_per_block).alias("__piece"))
    return placed.withColumn("__block", block).select(*df.columns, "__block")
