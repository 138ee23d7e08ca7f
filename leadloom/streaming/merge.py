"""Streaming forms: leads by foreachBatch, comments by watermarked de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leadloom.operators.intents import IntentRule
from leadloom.operators.leads import sightings
from leadloom.plans.jobs import fold_leads
from leadloom.sources.store import Tables


def fold_batch(tables: Tables, found: Callable[[int], DataFrame], batch_id: int, stream: str) -> bool:
    """Fold the sightings of one micro-batch, made for the version's number; False when it was folded before.

    A batch id counts within one stream only. The ledger of folded batches is part of the manifest that makes the change
    visible, so a replay does nothing after a finished try and starts over after an interrupted one. Only the buckets of
    the batch's phones are written.
    """
    if tables.has_folded(stream, batch_id):
        return False
    change = tables.change()
    fold_leads(change, found(change.version))
    change.commit(stream, batch_id)
    return True


def merge_batch(
    tables: Tables, posts: DataFrame, batch_id: int, rules: Sequence[IntentRule], stream: str = "stream", **options
) -> bool:
    """Fold one micro-batch of posts into the lead tables, see ``fold_batch``; ``options`` are those of ``lead_rows``."""
    return fold_batch(tables, lambda version: sightings(posts, None, rules, batch_no=version, **options), batch_id, stream)


def stream_leads(
    posts: DataFrame, tables: Tables, rules: Sequence[IntentRule], checkpoint: str, **options
) -> DataStreamWriter:
    """Writer that keeps the lead table up to date from a stream of posts; the caller starts it.

    The checkpoint folder is the stream's name: a stream with a new one counts its batches anew.
    """
    return (
        posts.writeStream.foreachBatch(
            lambda df, batch_id: merge_batch(tables, df, batch_id, rules, checkpoint, **options)
        )
        .option("checkpointLocation", checkpoint)
    )


def stream_first_comments(comments: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream with the first comment of each id; comments without an id all pass.

    Ids are remembered for ``delay`` after their event time, which bounds the state.
    """
    known = F.col("comment_id").isNotNull() & (F.col("comment_id") != "")
    once = (
        comments.filter(known)
        .withWatermark("captured_at", delay)
        .dropDuplicatesWithinWatermark(["comment_id"])
    )
    return once.unionByName(comments.filter(~F.coalesce(known, F.lit(False))))
