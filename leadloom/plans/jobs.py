"""Whole jobs: pages or posts and comments in, updated tables and a run record out.

A job writes all its tables in one change (``sources.store``): readers see all of it or nothing, and a failed or
repeated job never leaves half a table. Counts in run records come from the writes themselves.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.operators.intents import IntentRule
from leadloom.operators.leads import sightings
from leadloom.operators.merge import distinct_links, first_per_id, merge_leads
from leadloom.operators.posts import merge_posts, resolve_posts
from leadloom.sources.pages import group_page, posts_from_pages
from leadloom.sources.sinks import export_leads
from leadloom.sources.store import Change, Tables
from leadloom.sources.tables import PAGES_A_TASK, spread


def fold_leads(change: Change, found: DataFrame) -> tuple[int, int]:
    """Fold sightings into the leads and their links, in the buckets they touch; returns (inserted, duplicates).

    Inserted are the leads that were not there before, duplicates all other sightings. A lead's links are cut by lead and
    link, so a lead with very many spans all buckets.
    """
    found, seen = change.replace("sightings", found)
    key, by = ["phone_normalized"], ["phone_normalized", "link"]
    touched = change.touched(found, *key)
    state = change.read("leads", schemas.LEADS, touched)
    known = 0 if state is None else state.count()  # of the file footers
    inserted = change.replace_buckets("leads", merge_leads(found, state), schemas.LEADS, key, touched) - known
    touched = change.touched(distinct_links(found), *by)
    links = distinct_links(found, state=change.read("lead_links", schemas.LEAD_LINKS, touched))
    change.replace_buckets("lead_links", links, schemas.LEAD_LINKS, by, touched)
    return inserted, seen["n"] - inserted


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)


def ingest_pages(
    tables: Tables,
    pages: DataFrame,
    rules: Sequence[IntentRule],
    group_id: str,
    *,
    limit: int | None = None,
    source_mode: str = "cached",
    status: str = "cache_only",
    **options,
) -> dict:
    """Pages to leads and a run record; posts and comments themselves are not stored.

    ``pages``: page_id, html, captured_at. Pages without any post give the status
    ``empty_or_markup_changed``; an error is recorded as ``parser_error`` and raised. ``options`` are those of
    ``lead_rows``.
    """
    started = _now()
    run = {"started_at": started, "source_mode": source_mode, "posts_requested": limit, "source_kind": "anonymous"}
    try:
        posts = posts_from_pages(pages, keep=("page_id", "captured_at"))
        if limit is not None:
            posts = posts.orderBy("page_id", "post_no").limit(limit)
        shaped = posts.select(
            "text", "link", F.lit(group_id).alias("source_group_id"), F.col("captured_at").alias("seen_at"),
            F.col("page_id").alias("post_order"), F.col("post_no").alias("comment_order"),
        )
        change = tables.change()
        shaped, seen = change.replace("page_posts", shaped)
        n_posts = seen["n"]
        if n_posts == 0:
            status = "empty_or_markup_changed"
        # Whole posts are judged, which takes far longer than to move them: no task grows with the input.
        posts = spread(shaped, PAGES_A_TASK, n_posts)
        inserted, duplicates = fold_leads(change, sightings(posts, None, rules, batch_no=change.version, **options))
        change.commit()
    except Exception as exc:
        tables.add_run(
            **run, finished_at=_now(), status="parser_error", posts_fetched=0, posts_parsed=0, leads_inserted=0,
            leads_skipped_duplicate=0, error_class=type(exc).__name__, error_detail=str(exc),
        )
        raise
    outcome = {
        "posts_fetched": n_posts, "posts_parsed": n_posts,
        "leads_inserted": inserted, "leads_skipped_duplicate": duplicates,
    }
    tables.add_run(**run, **outcome, finished_at=_now(), status=status)
    return {**outcome, "status": status}


def ingest_posts_and_comments(
    tables: Tables, posts: DataFrame, comments: DataFrame, rules: Sequence[IntentRule], group_id: str, **options
) -> dict:
    """Posts and comments to the post, comment and lead tables and a run record.

    ``posts``: post_ref, post_order, post_fb_id, permalink, author, author_fb_id, timestamp_unix, text, seen_at.
    ``comments``: post_ref, comment_order, comment_id, parent_comment_id, author, author_fb_id, text,
    timestamp_unix, is_reply, captured_at.
    """
    started = _now()
    try:
        outcome = _change_by_posts_and_comments(tables, posts, comments, rules, group_id, **options)
    except Exception as exc:
        _record_group_failure(tables, started, exc)
        raise
    tables.add_run(
        **{k: outcome[k] for k in ("posts_fetched", "posts_parsed", "leads_inserted", "leads_skipped_duplicate")},
        started_at=started, finished_at=_now(), source_mode="live", status="live_success",
        posts_requested=outcome["posts_fetched"], source_kind="browser_authenticated",
    )
    return outcome


def _record_group_failure(tables: Tables, started: dt.datetime, exc: Exception) -> None:
    tables.add_run(
        started_at=started, finished_at=_now(), source_mode="live", status="parser_error", posts_fetched=0,
        posts_parsed=0, leads_inserted=0, leads_skipped_duplicate=0, source_kind="browser_authenticated",
        error_class=type(exc).__name__, error_detail=str(exc),
    )


def _change_by_posts_and_comments(
    tables: Tables, posts: DataFrame, comments: DataFrame, rules: Sequence[IntentRule], group_id: str, **options
) -> dict:
    """Posts, comments, leads and links in one change; returns its counts."""
    change = tables.change()
    rows = posts.select(
        "post_ref", "post_order", F.col("post_order").alias("seq"), "post_fb_id", "permalink", "author",
        "author_fb_id", "timestamp_unix", F.col("text").alias("raw_text"),
        F.lit(group_id).alias("source_group_id"), F.lit("browser").alias("source_kind"), "seen_at",
    )
    rows, seen_posts = change.replace("posts_in", rows)
    known_posts = change.read("posts", schemas.POSTS)
    keyed, _ = change.replace("posts_keyed", resolve_posts(rows, state=known_posts))
    merged = merge_posts(rows.drop("post_ref", "post_order"), state=known_posts)
    change.replace("posts", schemas.evolve(merged, schemas.POSTS))

    # Comments of a post that is not in the batch are counted, not lost silently.
    said = comments.join(
        keyed.select("post_ref", "post_key", "post_order", F.col("permalink").alias("link")), "post_ref", "left"
    )
    said, seen_comments = change.replace("comments_in", said, attempts=F.count("post_key"))
    said = said.filter(F.col("post_key").isNotNull())
    known_comments = change.read("comments", schemas.COMMENTS)
    order = F.struct("post_order", "comment_order")
    fresh = first_per_id(said.withColumn("__seq", order), "comment_id", "__seq", known_comments)
    own_key = F.sha2(F.concat_ws("|", "post_key", "comment_order", F.lit(change.version), "text"), 256)
    fresh = fresh.withColumn("comment_key", F.coalesce(F.nullif("comment_id", F.lit("")), own_key))
    fresh = schemas.evolve(fresh, schemas.COMMENTS)
    table = fresh if known_comments is None else known_comments.unionByName(fresh)
    _, seen_table = change.replace("comments", table)
    n_before = 0 if known_comments is None else known_comments.count()  # of the file footers

    post_texts = rows.select(
        F.col("raw_text").alias("text"), F.col("permalink").alias("link"), "source_group_id", "post_order", "seen_at"
    )
    comment_texts = said.select(
        "text", "link", F.lit(group_id).alias("source_group_id"), "post_order", "comment_order",
        F.col("captured_at").alias("seen_at"), "author", "timestamp_unix", F.col("link").alias("permalink"),
    )
    found = sightings(post_texts, comment_texts, rules, batch_no=change.version, **options)
    inserted, duplicates = fold_leads(change, found)
    change.commit()
    return {
        "posts_fetched": seen_posts["n"], "posts_parsed": seen_posts["n"], "leads_inserted": inserted,
        "leads_skipped_duplicate": duplicates, "comment_attempts": seen_comments["attempts"],
        "comments_inserted": seen_table["n"] - n_before,
        "comments_without_post": seen_comments["n"] - seen_comments["attempts"],
    }


def ingest_group_pages(
    tables: Tables, pages: DataFrame, rules: Sequence[IntentRule], group_id: str, **options
) -> dict:
    """Pages of single posts, as HTML, to the post, comment and lead tables and a run record.

    ``pages``: page_id, url, html, captured_at. An error is recorded as ``parser_error`` and raised.
    """
    started = _now()
    try:
        posts, comments = group_page(pages)
    except Exception as exc:
        _record_group_failure(tables, started, exc)
        raise
    return ingest_posts_and_comments(tables, posts, comments, rules, group_id, **options)


def ingest_and_export(
    tables: Tables, pages: DataFrame, rules: Sequence[IntentRule], group_id: str, folder: str,
    output_format: str = "csv", *, limit: int | None = None, mask: bool = True,
) -> str:
    """``ingest_pages``, then an export of the whole lead table."""
    ingest_pages(tables, pages, rules, group_id, limit=limit)
    return export_job(tables, folder, output_format, mask=mask)


def export_job(
    tables: Tables, folder: str, output_format: str = "csv", *, intent: str | None = None,
    since: str | None = None, limit: int | None = None, mask: bool = True,
) -> str:
    """A filtered export of the current lead table."""
    now = tables.snapshot()
    leads, links = tables.read_from(now, "leads", schemas.LEADS), tables.read_from(now, "lead_links", schemas.LEAD_LINKS)
    if leads is None or links is None:
        raise ValueError("there are no leads yet")
    return export_leads(leads, links, folder, output_format, intent=intent, since=since, limit=limit, mask=mask)
