"""Comment threads: parents and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.ranking import rank_within_key


def resolve_parents(comments: DataFrame) -> DataFrame:
    """Add ``parent_key``, the key of the comment that ``parent_comment_id`` names in the same post.

    ``(post_key, comment_id)`` is unique, so no row multiplies; a parent with very many
    replies is a skewed left side, which AQE splits.
    """
    parents = comments.filter(F.col("comment_id").isNotNull()).select(
        "post_key", F.col("comment_id").alias("parent_comment_id"), F.col("comment_key").alias("parent_key")
    )
    return comments.join(parents, ["post_key", "parent_comment_id"], "left").select(*comments.columns, "parent_key")


def _reading_order() -> list:
    return [
        F.col("parent_comment_id").isNotNull(),
        F.coalesce(F.col("timestamp_unix"), F.lit(0)),
        F.col("comment_key"),
    ]


def thread(comments: DataFrame, post_key: str) -> DataFrame:
    """One post's comments: top level first, then by time, then by key."""
    return comments.filter(F.col("post_key") == post_key).orderBy(*_reading_order())


def thread_positions(comments: DataFrame) -> DataFrame:
    """``post_key, comment_key, position`` of all posts' comments in reading order; only these slim rows are sorted."""
    parts = [c.alias(f"__{i}") for i, c in enumerate(_reading_order()[:2])]
    slim = comments.select("post_key", "comment_key", *parts)
    ranked = rank_within_key(slim, ["post_key"], ["__0", "__1", "comment_key"])
    return ranked.select("post_key", "comment_key", "position")


def threads(comments: DataFrame) -> DataFrame:
    """All posts' comments in reading order, with their ``position`` in the thread; other columns are joined to it by key.

    ``(post_key, comment_key)`` has to name one row, as in the comment table; a null counts as a value.
    """
    at = thread_positions(comments).toDF("__post", "__comment", "position")
    same = F.col("post_key").eqNullSafe(F.col("__post")) & F.col("comment_key").eqNullSafe(F.col("__comment"))
    return comments.join(at, same).select(*comments.columns, "position")
