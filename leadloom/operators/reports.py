"""Report queries over the lead, run, post and comment tables.

Counts are partial aggregates; ordered lists with a limit are top-k plans. Reports that
join a limited list pick the list first and join only its few rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab

DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def list_leads(
    leads: DataFrame, *, intent: str | None = None, since: str | None = None, limit: int | None = None
) -> DataFrame:
    """Leads by recency, then sightings; ``since`` is a YYYY-MM-DD day of the last sighting."""
    if since is not None:
        if not DATE.match(since):
            raise ValueError("since must be YYYY-MM-DD")
        # A plain comparison with midnight reaches the scan; a cast of the column would not.
        leads = leads.filter(F.col("last_seen") >= F.to_timestamp(F.lit(since)))
    if intent:
        if intent not in vocab.INTENTS:
            raise ValueError(f"unknown intent: {intent}")
        leads = leads.filter(F.col("intent") == intent)
    order = [F.col("last_seen").desc(), F.col("post_count").desc(), F.col("phone_normalized")]
    return _limited(leads.orderBy(*order), limit)


def top_contacts(leads: DataFrame, limit: int = 10) -> DataFrame:
    """The first of ``list_leads``: most recent first, sightings break ties."""
    return list_leads(leads, limit=limit)


def top_by_count(leads: DataFrame, limit: int = 10) -> DataFrame:
    """Most sightings first."""
    return leads.orderBy(F.col("post_count").desc(), F.col("last_seen").desc(), "phone_normalized").limit(limit)


def total(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def counts_by_intent(leads: DataFrame) -> DataFrame:
    return leads.groupBy("intent").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "intent")


def counts_by_prefix(leads: DataFrame, country_code: str = vocab.HOME_COUNTRY_CODE) -> DataFrame:
    """Leads per two-digit prefix of one country's numbers."""
    home = "+" + country_code
    return (
        leads.filter(F.col("phone_normalized").startswith(home))
        .groupBy(F.substring("phone_normalized", len(home) + 1, 2).alias("prefix"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "prefix")
    )


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def runs_by_mode(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_mode").agg(F.count("*").alias("count"))


def last_runs(runs: DataFrame, success: tuple[str, ...] = vocab.SUCCESS_STATUSES) -> DataFrame:
    """One row: the last run and the last successful run, as structs, in one pass."""
    row, at = F.struct(*runs.columns), F.struct("started_at", "run_id")
    return runs.agg(
        F.max_by(row, at).alias("last_run"),
        F.max_by(row, F.when(F.col("status").isin(*success), at)).alias("last_success"),
    )


def posts_with_counts(posts: DataFrame, comments: DataFrame, limit: int = 50) -> DataFrame:
    """Newest posts with their comment counts, posts without comments included.

    The posts are picked first; only their comments are counted. AQE sees how many they are.
    """
    newest = posts.orderBy(F.col("first_seen").desc(), F.col("post_key").desc()).limit(limit)
    counts = (
        comments.select("post_key")
        .join(newest.select("post_key"), "post_key", "left_semi")
        .groupBy("post_key")
        .agg(F.count("*").alias("comment_count"))
    )
    return newest.join(counts, "post_key", "left").withColumn(
        "comment_count", F.coalesce("comment_count", F.lit(0).cast("bigint"))
    )


def all_posts_with_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Every post with its comment count; comments shrink to one row per post before the join."""
    counts = comments.groupBy("post_key").agg(F.count("*").alias("comment_count"))
    return posts.join(counts, "post_key", "left").withColumn(
        "comment_count", F.coalesce("comment_count", F.lit(0).cast("bigint"))
    )


def recent_comments(posts: DataFrame, comments: DataFrame, limit: int = 50) -> DataFrame:
    """Newest comments with their post's id, permalink, author and text.

    The comments are picked first, so both joins have at most ``limit`` rows on one side.
    """
    newest = comments.orderBy(F.col("captured_at").desc(), F.col("comment_key").desc()).limit(limit)
    theirs = posts.select(
        "post_key",
        "post_fb_id",
        "permalink",
        F.col("author").alias("post_author"),
        F.col("raw_text").alias("post_text"),
    ).join(newest.select("post_key").distinct(), "post_key", "left_semi")
    return newest.join(theirs, "post_key", "left")


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("post_key").agg(F.count("*").alias("n"))


def stats(leads: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """Total, counts by intent and prefix, runs by mode and the last runs."""
    return {
        "total_leads": total(leads),
        "by_intent": counts_by_intent(leads),
        "by_phone_prefix": counts_by_prefix(leads),
        "runs_by_mode": runs_by_mode(runs),
        "last_runs": last_runs(runs),
    }


def report_bundle(leads: DataFrame, posts: DataFrame, comments: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """All data of the overview page; the caller decides what to show or write."""
    return {
        **stats(leads, runs),
        "total_posts": total(posts),
        "total_comments": total(comments),
        "top_contacts": top_contacts(leads, 20),
        "posts": posts_with_counts(posts, comments, 50),
        "comments": recent_comments(posts, comments, 100),
        "runs": recent_runs(runs, 20),
    }
