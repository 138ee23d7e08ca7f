"""Sliding-window activity per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom import vocab
from leadloom.operators.ranking import range_sorted


def trailing_activity(
    events: DataFrame,
    source: str = "source",
    ts: str = "ts",
    event_id: str = "event_id",
    *,
    seconds: int = vocab.ACTIVITY_WINDOW_SECONDS,
    cap: int = vocab.ACTIVITY_CAP,
) -> DataFrame:
    """Per event: earlier events of its source in the window, and seconds until a slot is free.

    An event exactly ``seconds`` old still counts; equal times are ordered by id; events without a time drop out. Each event
    leaves two rows in one global order by source and time: itself, and the moment its window begins. The events so far at
    the one less those at the other lie in the window. The order is cut into range partitions, so a source and a window of
    any size spread over all tasks; counts run within a partition and go on from the sums of the source's earlier ones.
    """
    width = seconds * 1_000_000
    keyed = events.select(
        F.col(source).alias("__source"),
        F.col(event_id).alias("__id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"),
        F.struct(*events.columns).alias("__event"),
        F.monotonically_increasing_id().alias("__key"),
    ).filter(F.col("__us").isNotNull())
    moment = F.explode(F.array(*[F.struct((F.col("__us") - back).alias("at"), F.lit(n).alias("n")) for back, n in ((width, 0), (0, 1))]))
    walked = keyed.withColumn("__moment", moment).select(
        "__source", "__id", "__key", "__us", F.col("__moment.at").alias("__at"), F.col("__moment.n").alias("__n"),
        F.when(F.col("__moment.n") == 0, F.col("__event")).alias("__event"),
    )
    placed = range_sorted(walked, ["__source"], ["__at", "__n", "__id", "__key"])
    arrival = F.when(F.col("__n") == 1, F.col("__at"))
    run = W.partitionBy("__part", "__source")
    here = placed.withColumns(
        {
            "__before": F.coalesce(F.sum("__n").over(run.orderBy("__row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "__next": F.last(arrival, ignorenulls=True).over(run.orderBy(F.desc("__row")).rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    # One slim row for each source and partition: what lies before a run, and the first event behind it.
    runs = placed.groupBy("__source", "__part").agg(F.sum("__n").alias("__sum"), F.min(arrival).alias("__first"))
    parts = W.partitionBy("__source")
    runs = runs.select(
        F.col("__source").alias("__of"),
        F.col("__part").alias("__in"),
        F.coalesce(F.sum("__sum").over(parts.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"),
        F.last("__first", ignorenulls=True).over(parts.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)).alias("__later"),
    )
    counted = here.join(runs, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    so_far = F.col("__before") + F.col("__earlier")
    begins = F.col("__n") == 0
    both = counted.groupBy("__key").agg(
        F.max(F.when(~begins, so_far)).alias("__rank"),
        F.max(F.when(begins, so_far)).alias("__gone"),
        F.max(F.when(begins, F.coalesce("__next", "__later"))).alias("__oldest"),
        F.max("__us").alias("__us"),
        F.first("__event", ignorenulls=True).alias("__event"),
    )
    earlier = F.col("__rank") - F.col("__gone")
    wait = F.greatest(F.col("__oldest") + width - F.col("__us"), F.lit(0)) / F.lit(1_000_000.0)
    return both.select(
        "__event.*",
        earlier.cast("bigint").alias("in_window"),
        F.when(earlier < cap, F.lit(0.0)).otherwise(wait).alias("seconds_to_next_slot"),
    )


def mean_gap(events: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """Average seconds between a source's successive events; null for a single one.

    The gaps add up to the whole span, so no ordering is needed.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (F.max(us) - F.min(us)) / (F.count("*") - 1) / F.lit(1_000_000.0)
    return events.groupBy(source).agg(
        F.count("*").alias("n"), F.when(F.count("*") > 1, gap).alias("mean_gap_seconds")
    )
