"""Texts to lead sightings: one row per text and phone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import leads as ld
from leadloom.functions import phones as ph
from leadloom.functions import text as tx
from leadloom.operators.intents import IntentRule, classify_intents

# Optional input columns and their types; a missing one counts as null.
ENRICHMENT = {
    "link": "string",
    "author": "string",
    "timestamp_unix": "bigint",
    "permalink": "string",
    "reactions_count": "bigint",
    "comments_count": "bigint",
}


def lead_rows(
    posts: DataFrame,
    rules: Sequence[IntentRule],
    *,
    text_col: str = "text",
    keep: Sequence[str] = (),
    other_countries: Sequence[tuple[str, int]] = ph.ALL_COUNTRIES,
    kinds: Mapping[str, str] | None = None,
    price_pattern: str = vocab.PRICE_CONTEXT,
) -> DataFrame:
    """One row per text and distinct phone; texts without a phone give none.

    Texts without phones leave before classification, so the rules only run on the rest.
    ``keep`` names further columns to carry. No shuffle.
    """
    for name, kind in ENRICHMENT.items():
        if name not in posts.columns:
            posts = posts.withColumn(name, F.lit(None).cast(kind))
    called = ph.only_with_phones(
        posts, text_col, "__phones", other_countries=other_countries, kinds=kinds, price_pattern=price_pattern
    )
    judged = classify_intents(called, rules, text_col, has_phone=True, out="__intent")
    described = judged.withColumn("__clean", tx.compact_text(F.col(text_col))).select(
        *keep,
        "source_group_id",
        F.col("__clean").alias("raw_text"),
        ld.extract_name(F.col("__clean")).alias("name"),
        ld.extract_what(F.col("__clean"), F.col("__intent.intent")).alias("what"),
        ld.extract_why(F.col("__clean")).alias("why"),
        F.col("__intent.intent").alias("intent"),
        F.col("__intent.confidence").alias("intent_confidence"),
        F.col("__intent.matched_keywords").alias("intent_matched_keywords"),
        F.col("__intent.raw_excerpt").alias("intent_raw_excerpt"),
        ld.lead_links(F.col(text_col), F.col("link"), F.col("permalink")).alias("links"),
        "author",
        "timestamp_unix",
        "permalink",
        "reactions_count",
        "comments_count",
        F.posexplode("__phones").alias("phone_pos", "__phone"),
    )
    return described.select(
        *keep,
        "phone_pos",
        F.col("__phone.raw").alias("phone_raw"),
        F.col("__phone.e164").alias("phone_normalized"),
        F.col("__phone.kind").alias("phone_kind"),
        *[c for c in described.columns if c not in {"phone_pos", "__phone", *keep}],
    )


def order_number(name: str) -> Column:
    """An order column as a number; a value that is none stops the job with a plain message."""
    value = F.col(name)
    number = value.try_cast("bigint")
    said = F.concat(F.lit(f"{name} has to be a whole number, not: "), value.cast("string"))
    return F.when(value.isNull() | number.isNotNull(), number).otherwise(F.raise_error(said).cast("bigint"))


def sightings(
    posts: DataFrame,
    comments: DataFrame | None,
    rules: Sequence[IntentRule],
    *,
    batch_no: int = 0,
    **options,
) -> DataFrame:
    """Lead rows of posts and their comments in one frame, with a total order ``seq``.

    ``posts``: text, link, source_group_id, post_order, seen_at; comment_order may break ties.
    ``comments``: the same plus comment_order, author, timestamp_unix, permalink.
    """
    own = posts.withColumn("is_comment", F.lit(0))
    if "comment_order" not in posts.columns:
        own = own.withColumn("comment_order", F.lit(0).cast("bigint"))
    keep = ["post_order", "is_comment", "comment_order", "seen_at"]
    found = lead_rows(own, rules, keep=keep, **options)
    if comments is not None:
        found = found.unionByName(lead_rows(comments.withColumn("is_comment", F.lit(1)), rules, keep=keep, **options))
    seq = F.struct(
        F.lit(batch_no).cast("bigint").alias("batch_no"),
        order_number("post_order").alias("post_order"),
        F.col("is_comment").cast("int").alias("is_comment"),
        order_number("comment_order").alias("comment_order"),
        F.col("phone_pos").cast("int").alias("phone_pos"),
    )
    return found.withColumn("seq", seq).drop(*keep[:3], "phone_pos")
