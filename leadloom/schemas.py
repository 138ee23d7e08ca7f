"""Declared schemas of the persistent tables, and reading older data into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """``name type`` pairs as a schema; needs no session, unlike Spark's own DDL reader."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LEADS = _schema(
    "phone_normalized string, phone_raw string, name string, what string, why string, intent string, "
    "intent_confidence double, intent_matched_keywords array<string>, intent_raw_excerpt string, "
    "first_seen timestamp, last_seen timestamp, post_count bigint, "
    "source_group_id string, raw_text string, author string, timestamp_unix bigint, permalink string, "
    "reactions_count bigint, comments_count bigint"
)
# One row per lead and link: a lead's list may be long, so it is no cell of the lead table.
SEQUENCE = T.StructType(
    [
        T.StructField("batch_no", T.LongType()),
        T.StructField("post_order", T.LongType()),
        T.StructField("is_comment", T.IntegerType()),
        T.StructField("comment_order", T.LongType()),
        T.StructField("phone_pos", T.IntegerType()),
    ]
)
LEAD_LINKS = T.StructType(
    [
        T.StructField("phone_normalized", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField(
            "first_at", T.StructType([T.StructField("seq", SEQUENCE), T.StructField("pos", T.IntegerType())])
        ),
    ]
)
RUNS = _schema(
    "run_id string, started_at timestamp, finished_at timestamp, source_mode string, status string, "
    "posts_fetched bigint, posts_parsed bigint, leads_inserted bigint, leads_skipped_duplicate bigint, "
    "error_class string, error_detail string, raw_response_path string, posts_requested bigint, source_kind string"
)
POSTS = _schema(
    "post_key string, post_fb_id string, permalink string, author string, author_fb_id string, "
    "timestamp_unix bigint, raw_text string, first_seen timestamp, last_seen timestamp, "
    "source_group_id string, source_kind string"
)
COMMENTS = _schema(
    "comment_key string, post_key string, parent_comment_id string, comment_id string, author string, "
    "author_fb_id string, text string, timestamp_unix bigint, is_reply boolean, captured_at timestamp"
)
POST_FILES = _schema(
    "id string, text string, expected_phones array<string>, expected_intent string, expected_leads bigint"
)

# A lead table without these columns is from before evidence was kept and cannot be carried on.
REQUIRED_LEAD_COLUMNS = (
    "phone_raw", "phone_normalized", "intent", "intent_confidence", "intent_matched_keywords", "intent_raw_excerpt",
)


def is_compatible(columns: list[str]) -> bool:
    return set(REQUIRED_LEAD_COLUMNS) <= set(columns)


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Older rows in the declared shape: columns added since are null, unknown ones go."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
