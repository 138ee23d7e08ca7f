"""Stored pages to posts and comments. A page is one row, so all of this is shuffle-free."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import html as hx
from leadloom.functions import markup as mk
from leadloom.functions import text as tx
from leadloom.functions import times, urls

# ---- fixed values: what a post's element looks like; all kinds count, in this order ----
POST_ELEMENTS = (
    ("article", "."),
    ("div", r"(?is)\sdata-ft\b"),
    ("div", hx.ARTICLE_ROLE),
    ("div", r"(?is)\sclass=(?:\"[^\"]*|'[^']*)\bstory_body_container\b"),
    ("div", r"(?is)\sclass=(?:\"[^\"]*|'[^']*)\buserContentWrapper\b"),
)
PARAGRAPH = r"(?is)<p\b[^>]*>.*?</p>"


def post_blocks(html: Column) -> Column:
    """Post-like blocks of a page: the elements of all post kinds, nested ones too; else paragraphs, else divs."""

    def pick(clean: Column) -> Column:
        none = F.array().cast("array<string>")
        shown = [clean.rlike(rf"(?is)<{tag}\b[^>]*{wanted.removeprefix('(?is)')}") for tag, wanted in POST_ELEMENTS]

        def kinds(page: Column) -> Column:
            def of_tags(articles: Column, divs: Column) -> Column:
                found = {"article": articles, "div": divs}
                blocks = [mk.element_texts(page, mk.matching(page, found[tag], wanted)) for tag, wanted in POST_ELEMENTS]
                return F.concat(*[F.when(there, block).otherwise(none) for there, block in zip(shown, blocks)])

            return tx.let(mk.elements(page, "div"), lambda divs: of_tags(mk.elements(page, "article"), divs))

        some = F.when(reduce(lambda a, b: a | b, shown), tx.let(mk.markup(clean), kinds)).otherwise(none)
        plain = (
            F.when(clean.rlike(r"(?is)<p\b"), F.regexp_extract_all(clean, F.lit(PARAGRAPH), F.lit(0)))
            .when(clean.rlike(r"(?is)<div\b"), hx.balanced_blocks(clean, "div", "."))
            .otherwise(none)
        )
        return tx.let(some, lambda found: F.when(F.size(found) > 0, found).otherwise(plain))

    return tx.let(hx.without_invisible(html), pick)


def page_posts(html: Column, limit: int | None = None, base: str = vocab.DEFAULT_RELATIVE_BASE) -> Column:
    """``array<struct<post_id,text,link,block>>``: blocks with enough text, exact copies once."""

    def described(block: Column, i: Column) -> Column:
        own_id = hx.attribute(F.regexp_extract(block, r"(?s)^<[^>]*>", 0), "data-post-id")
        return F.struct(
            F.coalesce(F.nullif(own_id, F.lit("")), F.concat(F.lit("html-"), (i + 1).cast("string"))).alias("post_id"),
            hx.element_text(block).alias("text"),
            hx.first_link(block, base).alias("link"),
            block.alias("block"),
        )

    described_blocks = F.transform(post_blocks(html), described)
    long_enough = F.filter(described_blocks, lambda p: F.length(p["text"]) >= vocab.MIN_POST_CHARS)
    kept = mk.first_of_equal(long_enough, lambda p: p["text"])
    return kept if limit is None else F.slice(kept, 1, limit)


def posts_from_pages(
    pages: DataFrame,
    *,
    limit: int | None = None,
    group_id: str | None = None,
    base: str = vocab.DEFAULT_RELATIVE_BASE,
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """One row per post of each page, with its place on the page and its enrichment fields.

    The outer generator keeps Spark from adding a filter that would parse every page twice.
    """
    listed = pages.withColumn("__posts", page_posts(F.col("html"), limit, base)).select(
        *keep, F.posexplode_outer("__posts").alias("post_no", "__post")
    ).filter(F.col("post_no").isNotNull())
    block = F.col("__post.block")
    return listed.select(
        *keep,
        (F.col("post_no") + 1).alias("post_no"),
        F.col("__post.post_id").alias("post_id"),
        F.col("__post.text").alias("text"),
        F.col("__post.link").alias("link"),
        hx.author(block).alias("author"),
        (F.lit(None).cast("string") if group_id is None else hx.permalink(block, group_id)).alias("permalink"),
        hx.timestamp_unix(block).alias("timestamp_unix"),
        hx.reactions_count(block).alias("reactions_count"),
        hx.comments_count(block).alias("comments_count"),
    )


def with_page_status(pages: DataFrame, status_code: str | None = None, *, strict: bool = True) -> DataFrame:
    """Add ``n_posts`` and ``status`` (null for a good page)."""
    code = F.lit(None).cast("int") if status_code is None else F.col(status_code)
    return pages.withColumn("n_posts", F.size(page_posts(F.col("html")))).withColumn(
        "status", hx.fetch_status(F.col("html"), code, F.col("n_posts"), strict=strict)
    )


def load_pages(spark, path: str, *, as_text: bool = False) -> DataFrame:
    """Stored pages: parquet rows, or one HTML file per page."""
    if not as_text:
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html")
    )


def post_fields(blocks: DataFrame, html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """Post fields of newer markup, one block per row; blocks without text, author and time drop out.

    Needs ``captured_at``. A block without an id gets one from its content.
    """
    url = F.col(url_col) if url_col else urls.post_link(F.col(html_col))

    def fields(html: Column) -> Column:
        labels = F.transform(hx.link_labels(html), lambda text: times.parse_timestamp(text, F.col("captured_at")))
        posted_at = tx.let(
            hx.block_time_text(html),
            lambda shown: F.when(shown.isNotNull(), times.parse_timestamp(shown, F.col("captured_at"))).otherwise(
                F.get(F.filter(labels, lambda t: t.isNotNull()), F.lit(0))
            ),
        )
        return F.struct(
            url.alias("url"),
            hx.block_author(html).alias("author"),
            hx.block_message(html).alias("text"),
            posted_at.alias("timestamp"),
            F.concat(F.lit("gen_"), F.substring(F.sha2(html, 256), 1, 12)).alias("made_up"),
        )

    def if_useful(post: Column) -> Column:
        useful = (post["text"] != "") | post["author"].isNotNull() | post["timestamp"].isNotNull()
        return F.when(useful, F.array(post))

    # An outer generator, so that the test does not parse the blocks a second time.
    parsed = blocks.select(
        *[c for c in blocks.columns if c != html_col],
        F.explode_outer(tx.let(tx.let(F.col(html_col), fields), if_useful)).alias("__post"),
    ).filter(F.col("__post").isNotNull())
    post = F.col("__post")
    return parsed.select(
        *[c for c in parsed.columns if c != "__post"],
        F.coalesce(urls.post_id(post["url"]), post["made_up"]).alias("post_fb_id"),
        urls.canonical_url(post["url"]).alias("permalink"),
        post["author"].alias("author"),
        post["text"].alias("text"),
        post["timestamp"].alias("timestamp"),
        times.to_unix(post["timestamp"]).alias("timestamp_unix"),
    )


def comments_from_pages(pages: DataFrame, keep: Sequence[str] = ("page_id",), html_col: str = "html") -> DataFrame:
    """One row per comment of each page; needs ``captured_at``.

    The first of equal ids stays; a comment without a name and a text drops out. Replies
    point to the last comment before them. Comments without an id get one from place and
    content, so both of two equal ones stay and a re-run names them the same. A comment is
    its element, up to its own end tag.
    """

    def described(block: Column, i: Column) -> Column:
        made_up = F.concat(
            F.lit("fallback_"), F.substring(F.sha2(F.concat_ws("|", i.cast("string"), block), 256), 1, 10)
        )
        return F.struct(
            F.coalesce(hx.comment_id(block), made_up).alias("comment_id"),
            hx.commenter(block).alias("author"),
            hx.comment_text(block).alias("text"),
            hx.comment_time_text(block).alias("time_text"),
            hx.is_reply_block(block).alias("is_reply"),
            i.alias("place"),
        )

    def nested(found: Column) -> Column:
        # The last comment that isn't a reply, up to each place.
        openers = F.transform(found, lambda c: F.when(~c["is_reply"], c["comment_id"]))
        return tx.let(
            mk.last_known(openers),
            lambda last: F.transform(
                found, lambda c, i: F.struct(c.alias("c"), F.when(c["is_reply"], F.get(last, i)).alias("parent_comment_id"))
            ),
        )

    worth = F.filter(
        F.transform(hx.comment_blocks(F.col(html_col)), described),
        lambda c: c["author"].isNotNull() | ((c["text"] != "") & (c["text"] != "N/A")),
    )
    kept = mk.first_of_equal(worth, lambda c: c["comment_id"])
    rows = pages.withColumn("__comments", tx.let(kept, nested)).select(
        *keep, "captured_at", F.posexplode_outer("__comments").alias("comment_no", "__row")
    ).filter(F.col("comment_no").isNotNull())
    posted_at = times.parse_timestamp(F.col("__row.c.time_text"), F.col("captured_at"))
    return rows.select(
        *keep,
        F.col("__row.c.comment_id").alias("comment_id"),
        F.col("__row.parent_comment_id").alias("parent_comment_id"),
        F.col("__row.c.author").alias("author"),
        F.col("__row.c.text").alias("text"),
        posted_at.alias("timestamp"),
        times.to_unix(posted_at).alias("timestamp_unix"),
        F.col("__row.c.is_reply").alias("is_reply"),
        F.col("comment_no").cast("bigint").alias("comment_order"),
        "captured_at",
    )


def group_page(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of pages that show one post each with its comments: what the posts-and-comments job takes.

    The post is the page's first outermost element with the article role that lies in no list; lists of comments inside it
    are no part of it, other lists are. The comments of the page are its own. Needs ``page_id``, ``url``, ``html`` and ``captured_at``; pages without a post give nothing.
    """
    html = hx.without_comment_lists(hx.without_invisible(F.col("html")))
    first = F.get(hx.balanced_blocks(html, "div", hx.ARTICLE_ROLE, top_only=True), F.lit(0))
    blocks = pages.select("page_id", "url", "captured_at", first.alias("html")).filter(F.col("html").isNotNull())
    posts = post_fields(blocks, url_col="url").select(
        F.col("page_id").cast("string").alias("post_ref"), F.col("page_id").alias("post_order"), "post_fb_id", "permalink",
        "author", F.lit(None).cast("string").alias("author_fb_id"), "timestamp_unix", "text",
        F.col("captured_at").alias("seen_at"),
    )
    said = comments_from_pages(pages).select(
        F.col("page_id").cast("string").alias("post_ref"), "comment_order", "comment_id", "parent_comment_id", "author",
        F.lit(None).cast("string").alias("author_fb_id"), "text", "timestamp_unix", "is_reply", "captured_at",
    )
    return posts, said
