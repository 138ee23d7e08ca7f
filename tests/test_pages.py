import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html as hx
from leadloom.functions import times, urls
from leadloom.sources import pages as pg
from leadloom.sources.tables import spread

UTC = dt.timezone.utc


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string").withColumn(
        "captured_at", F.lit("2025-01-20 12:00:00").cast("timestamp")
    )


def test_articles_become_posts(spark):
    html = """<html><script>var t="</article>";</script><body>
      <article data-post-id="a1"><p>Atelier couture Tel 20 111 222</p><a href="/p/a1">link</a></article>
      <article data-post-id="a2"><p>Second post with &eacute;t&#233; &amp; more</p></article>
      <article><p>Second post with été &amp; more</p></article>
      <article>short</article>
      <article class='x'>A third post, long enough</article></body></html>"""
    rows = pg.posts_from_pages(page(spark, html)).orderBy("post_no").collect()
    assert [r["post_id"] for r in rows] == ["a1", "a2", "html-5"]
    assert rows[0]["link"] == "https://mbasic.facebook.com/p/a1"
    assert rows[1]["text"] == "Second post with été & more"
    assert pg.posts_from_pages(page(spark, html), limit=2).count() == 2


def test_paragraph_fallback_and_status(spark):
    df = spark.createDataFrame(
        [
            (1, "<p>One paragraph of some length</p><p>tiny</p>", 200),
            (2, "<html><body></body></html>", 200),
            (3, "<p>Please solve the CAPTCHA to go on</p>", 200),
            (4, "<p>You must log in to see this page</p>", 200),
            (5, "<p>One paragraph of some length</p>", 503),
            (6, "<p>One paragraph of some length</p>", 429),
            (7, "<title>Error</title><p>One paragraph of some length</p>", 200),
        ],
        "page_id long, html string, code int",
    )
    got = {r["page_id"]: r["status"] for r in pg.with_page_status(df, "code").collect()}
    assert got == {
        1: None, 2: "empty_or_markup_changed", 3: "blocked", 4: "login_wall", 5: "network_error", 6: "blocked", 7: None,
    }
    lax = {r["page_id"]: r["status"] for r in pg.with_page_status(df, "code", strict=False).collect()}
    assert lax[7] == "blocked"


def test_enrichment_fields(spark):
    seller = (
        "<article><header><a class=n href=\"/groups/31/user/9001/?ref=k\">Studio  Karma</a></header>"
        "<time><abbr class=t title=\"2023-02-28T23:59:58Z\">28 feb</abbr></time>"
        "<a href=\"https://site.example/groups/31/posts/8080/?c=1\">open</a>"
        "<em title=\"17 Reactions in all\">+</em><b>4 comments</b></article>"
    )
    assert one(spark, hx.author, seller) == "Studio Karma"
    assert one(spark, lambda c: hx.permalink(c, "31"), seller) == "https://site.example/groups/31/posts/8080/?c=1"
    assert one(spark, lambda c: hx.permalink(c, "3."), seller) is None
    assert one(spark, hx.timestamp_unix, seller) == int(dt.datetime(2023, 2, 28, 23, 59, 58, tzinfo=UTC).timestamp())
    assert one(spark, hx.timestamp_unix, "<i><abbr data-utime=\"1612137600\" /></i>") == 1612137600
    assert (one(spark, hx.reactions_count, seller), one(spark, hx.comments_count, seller)) == (17, 4)
    for field in (hx.author, lambda c: hx.permalink(c, "31"), hx.timestamp_unix, hx.reactions_count, hx.comments_count):
        assert one(spark, field, "<p>plain</p>") is None


@pytest.mark.parametrize(
    ("url", "pid"),
    [
        ("https://www.facebook.com/groups/knit.club/posts/a-b.c_9?x=/videos/1", "a-b.c_9"),
        ("https://m.facebook.com/groups/8/permalink/31337/?m=2", "31337"),
        ("https://m.facebook.com/story.php?id=4&story_fbid=pfbid0Zz", "pfbid0Zz"),
        ("/watch/?v=20202", "20202"),
        ("https://www.facebook.com/some.page/98765432101/about", "98765432101"),
        ("https://www.facebook.com/some.page/98765/about", None),
    ],
)
def test_post_ids(spark, url, pid):
    assert one(spark, urls.post_id, url) == pid


def test_post_link_and_canonical_url(spark):
    html = '<div><a href="https://other.example/posts/1">x</a><a href="/groups/1/posts/77?ref=a#b">y</a></div>'
    assert one(spark, urls.post_link, html) == "/groups/1/posts/77?ref=a#b"
    assert one(spark, lambda c: urls.canonical_url(urls.post_link(c)), html) == "https://www.facebook.com/groups/1/posts/77"
    assert one(spark, urls.post_link, "<div><p>No link here</p></div>") is None


def test_post_fields(spark):
    html = (
        '<div role="article"><h3>by <strong>Rim &amp; Co</strong></h3><section><div data-ad-preview="message"><p></p>'
        "<div>Deux <b>machines</b><div>à vendre</div></div><div> </div><div>Sfax</div></div></section>"
        '<abbr title="6 mars 2024 à 8:15">mars</abbr><a href="/groups/9/permalink/70/?k=v">lien</a></div>'
    )
    row = pg.post_fields(page(spark, html)).first()
    assert (row["author"], row["text"], row["post_fb_id"]) == ("Rim & Co", "Deux machines à vendre\nSfax", "70")
    assert row["permalink"] == "https://www.facebook.com/groups/9/permalink/70/"
    assert row["timestamp_unix"] == int(dt.datetime(2024, 3, 6, 8, 15, tzinfo=UTC).timestamp())
    assert pg.post_fields(page(spark, "<div><i></i></div>")).count() == 0
    only_name = "<div><h2><strong>سليم</strong></h2></div>"
    row = pg.post_fields(page(spark, only_name)).first()
    assert row["author"] == "سليم" and row["post_fb_id"].startswith("gen_")
    labelled = '<div><h2><strong>N</strong></h2><a aria-label="just a label here">a</a><a aria-label="12 May 2024">b</a></div>'
    assert pg.post_fields(page(spark, labelled)).first()["timestamp"].date() == dt.date(2024, 5, 12)


def test_nested_blocks_end_at_their_own_tag(spark):
    html = "<div a><div role='article' data-post-id=x>first one, outer <div role=\"article\">the inner article text</div> tail</div></div><p>footer</p>"
    rows = pg.posts_from_pages(page(spark, html)).orderBy("post_no").collect()
    assert [(r["post_id"], r["text"]) for r in rows] == [
        ("x", "first one, outer the inner article text tail"), ("html-2", "the inner article text"),
    ]
    kinds = '<div data-ft="1">a block of the second kind</div><div class="z userContentWrapper">a block of the fifth kind</div><article>a block of the first kind</article>'
    found = pg.posts_from_pages(page(spark, kinds)).orderBy("post_no").collect()
    assert [r["text"].split()[-2] for r in found] == ["first", "second", "fifth"]
    assert one(spark, lambda c: hx.balanced_blocks(c, "div", "."), "<div>a<div>b</div>") == ["<div>a<div>b</div>", "<div>b</div>"]


def test_very_long_messages(spark):
    children = "".join(f"<div>line {i}</div>" for i in range(20_000))
    html = f'<div role="article"><div data-ad-preview="message">{children}</div></div>'
    text = pg.post_fields(page(spark, html)).first()["text"]
    assert text.count("\n") == 19_999 and text.endswith("line 19999")
    flat = f'<div role="article"><h2><strong>A</strong></h2><div data-ad-preview="message">{"word " * 200_000}</div></div>'
    assert len(pg.post_fields(page(spark, flat)).first()["text"]) == 999_999


def said(label, inner):
    return f'<section><div class="k" aria-label="{label}">{inner}</div></section>'


def test_comments(spark):
    by = '<a href="/profile.php?id={0}"><span>{1}</span></a>'
    words = '<div><div data-ad-preview="message"><span>{0}</span></div></div>'
    html = (
        said("Commentaire de Mia", by.format(4, "Mia") + words.format("Combien ?") + '<a href="/x?comment_id=71&amp;q=1">l</a>')
        + said("Commentaire de Mia", by.format(4, "Mia") + words.format("twice") + '<a href="/x?comment_id=71">l</a>')
        + said("Reponse de Zed", by.format(5, "Zed") + words.format("vingt") + '<abbr title="10 minutes">m</abbr>')
        + said("Comment by", words.format("nobody said this"))
        + '<ul><li><div><div role="article" data-commentid="88">' + by.format(6, "Ola")
        + '<a aria-label="Comment permalink 3 days ago" href="#">3d</a></div></div></li></ul>'
        + said("Comment by", "<div></div>") + "<footer>" + by.format(7, "Site Admin") + words.format("Suggested for you") + "</footer>"
    )
    rows = pg.comments_from_pages(page(spark, html)).orderBy("comment_order").collect()
    assert [(r["author"], r["text"], r["is_reply"]) for r in rows] == [
        ("Mia", "Combien ?", False), ("Zed", "vingt", True), (None, "nobody said this", False), ("Ola", "", False),
    ]
    assert [r["comment_id"] for r in rows][::3] == ["71", "88"] and rows[1]["parent_comment_id"] == "71"
    assert rows[3]["timestamp_unix"] == int(dt.datetime(2025, 1, 17, 12, tzinfo=UTC).timestamp())
    assert pg.comments_from_pages(page(spark, "<div>none</div>")).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2 hrs ago", (2025, 1, 20, 10, 0)),
        ("Yesterday at 5:00 PM", (2025, 1, 19, 17, 0)),
        ("il y a 3 h", (2025, 1, 20, 9, 0)),
        ("منذ ساعتين", (2025, 1, 20, 10, 0)),
        ("January 15 at 3:00 PM", (2025, 1, 15, 15, 0)),
        ("Monday, January 6, 2025 at 9:30 AM", (2025, 1, 6, 9, 30)),
        ("3 days ago", (2025, 1, 17, 12, 0)),
        ("2 months ago", (2024, 11, 20, 12, 0)),
        ("an hour ago", (2025, 1, 20, 11, 0)),
        ("yesterday", (2025, 1, 19, 12, 0)),
        ("2024-12-31T23:00:00Z", (2024, 12, 31, 23, 0)),
        ("15 March 2024", (2024, 3, 15, 0, 0)),
        ("15 janvier à 15:00", (2025, 1, 15, 15, 0)),
        ("15 janvier 2025", (2025, 1, 15, 0, 0)),
        ("3 févr. 2025", (2025, 2, 3, 0, 0)),
        ("15 يناير 2025", (2025, 1, 15, 0, 0)),
        ("Monday at 3:00 PM", (2025, 1, 13, 15, 0)),
        ("lundi à 15:00", (2025, 1, 13, 15, 0)),
        ("Sunday", (2025, 1, 19, 0, 0)),
        ("15/01/2025 14:30", (2025, 1, 15, 14, 30)),
        ("May 5", (2025, 5, 5, 0, 0)),
        ("", None),
        ("nonsense", None),
    ],
)
def test_time_texts(spark, text, want):
    got = page(spark, text).select(times.to_unix(times.parse_timestamp(F.col("html"), F.col("captured_at")))).first()[0]
    assert got == (None if want is None else int(dt.datetime(*want, tzinfo=UTC).timestamp()))


def test_freshness(spark):
    df = spark.createDataFrame([("2025-01-10T00:00:00Z",), ("",), ("bad",)], "t string")
    now = F.lit("2025-01-20 12:00:00").cast("timestamp")
    rows = df.select(times.age_days(F.col("t"), now), times.is_fresh(F.col("t"), now, 30)).collect()
    assert (rows[0][0], rows[0][1]) == (10.5, True)
    assert rows[1][0] is None and not rows[1][1] and rows[2][0] is None


def test_lists_beside_and_inside_the_post(spark):
    menu = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/g">Groups</a></li></ul>'
    comment = '<li><div role="article" data-commentid="{0}"><a href="/user/2"><span>Bob</span></a><div dir="auto">said {0}</div>{1}</div></li>'
    said = "<ul>" + comment.format("c1", "<UL>" + comment.format("c2", "") + "</UL >") + "</ul>"
    post = '<div role="article"><h2><strong>Ann</strong></h2><div data-ad-preview="message"><div>To sell<ul><li>two machines</li></ul> in Sfax</div></div>{}</div>'
    shapes = [menu + post.format("") + said + menu, menu + post.format(said), "<ul>" + post.format("") + said, said + menu + post.format("")]
    df = spark.createDataFrame(list(enumerate(shapes)), "page_id long, html string").select(
        "*", F.lit("https://www.facebook.com/groups/1/posts/42").alias("url"), F.lit("2025-01-20 12:00:00").cast("timestamp").alias("captured_at")
    )
    posts, comments = pg.group_page(df)
    got = {r["post_ref"]: (r["author"], r["text"], r["post_fb_id"]) for r in posts.collect()}
    assert got == {str(i): ("Ann", "To sell two machines in Sfax", "42") for i in range(4)}
    assert sorted((r["post_ref"], r["comment_id"]) for r in comments.collect()) == [(str(i), c) for i in range(4) for c in ("c1", "c2")]
    assert one(spark, hx.without_comment_lists, None) is None and one(spark, hx.without_comment_lists, "<ul><li>a</ul>b") == "<ul><li>a</ul>b"


def plain_elements(html, tag, wanted):
    """The same by a stack, one tag at a time."""
    import re

    open_, done = [], []
    for m in re.finditer(rf"(?is)<{tag}(?:\s[^>]*)?>|</{tag}\s*>", html):
        if m[0].startswith("</"):
            if open_:
                start, fits = open_.pop()
                done += [(start, m.end())] if fits else []
        elif not m[0].endswith("/>"):
            open_.append((m.start(), bool(re.search(wanted, m[0]))))
    done += [(start, len(html)) for start, fits in open_ if fits]
    return [html[a:b] for a, b in sorted(done)]


def test_elements_equal_a_stack(spark):
    import random

    rng = random.Random(1)
    bits = ["<div>", "<div x>", '<div class="k">', "</div>", "</div >", "<div y/>", "<li>", "</li>", "<ul x>", "</ul>", "text", " é ", "<p>", "\x01", "\x02", "\x02a"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    html = F.col("html")
    rows = df.select("i", hx.balanced_blocks(html, "div", ".").alias("all"), hx.balanced_blocks(html, "div", r"\sx").alias("x"), hx.balanced_blocks(html, "li", ".").alias("li")).collect()
    for r in rows:
        assert r["all"] == plain_elements(pages[r["i"]], "div", ".")
        assert r["x"] == plain_elements(pages[r["i"]], "div", r"\sx")
        assert r["li"] == plain_elements(pages[r["i"]], "li", ".")


def test_very_many_comments(spark):
    item = '<li><div><div role="article" data-commentid="{0}"><a href="/user/2"><span>Bob</span></a><div dir="auto">said {0}</div></div></div></li>'
    html = "<ul>" + "".join(item.format(i % 19_000) for i in range(20_000)) + "</ul>"
    rows = pg.comments_from_pages(page(spark, html)).agg(F.count("*"), F.countDistinct("comment_id"), F.max("text")).first()
    assert tuple(rows) == (19_000, 19_000, "said 9999")
    posts = "".join(f"<article>post number {i % 15_000} of many</article>" for i in range(20_000))
    assert pg.posts_from_pages(page(spark, posts)).count() == 15_000


def test_flat_messages_are_read_as_by_elements(spark):
    """The short way for flat messages gives what matching the elements gives; odd markup goes the long way."""
    tag = '<div data-ad-preview="message">'
    blocks = [
        f"<div>a{tag}x<div>one &amp; two</div>\n<DIV class='c'>three<br>four</DIV > tail</div><div>z</div></div>",
        f"</div></div>{tag}alone <b>bold</b></div>", f"{tag}<div></div><div> </div>blank</div>", f"{tag}</div>after",
        f"{tag}<div>deep<div>er</div></div><div>next</div></div>", f"{tag}never <div>closed</div>", f"{tag}<div/>a<div />b</div>",
        '<div class="k" data-ad-preview="message" /><div dir="auto">self</div>', f"{tag}<li>x</li><article>y</article></div>",
        f"<article title='{tag}'>hidden</article>{tag}<div>shown</div></div>", f"{tag}a < b <div>c</div></div>",
        f"{tag}<!-- </div> --><div>note</div></div>", f"{tag}<divan>no</divan><div-x>p</div-x></div x>q</div>",
        f"{tag}<script>if (a) {{ }}</script><div>s\x01t\x02u</div></div>", f"{tag}<div>{'long ' * 500}</div><div>b</div></div>",
        f"{tag}first</div>{tag}second</div>", f"<div x>{tag}<div>in</div></div>", tag, "", None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, html string")
    short = {r["i"]: r["m"] for r in df.select("i", hx.block_message(F.col("html")).alias("m")).collect()}
    flat_chars, hx._FLAT_CHARS = hx._FLAT_CHARS, -1
    try:
        long = {r["i"]: r["m"] for r in df.select("i", hx.block_message(F.col("html")).alias("m")).collect()}
    finally:
        hx._FLAT_CHARS = flat_chars
    assert short == long
    assert short[0] == "one & two\nthree four" and short[1] == "alone bold" and short[4] == "deep er\nnext"


def test_time_text_is_cleaned_once(spark):
    df = spark.createDataFrame([("Monday, May 5, 2024 at 3:04 PM",)], "t string")
    read = df.select(times.parse_timestamp(F.col("t"), F.lit("2024-06-01").cast("timestamp")).alias("at"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    # The step that takes the joining words out stands once; before, at each of its uses.
    assert plan.count(",|(?<!") == 1
    assert read.first()["at"] == dt.datetime(2024, 5, 5, 15, 4)


def test_heavy_rows_are_cut_by_number(spark, tmp_path):
    """Rows that hardly take a byte in the file are cut, too."""
    spark.range(20_000).select("id", F.lit("<p>page</p>" * 9).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert spread(rows, 500).rdd.getNumPartitions() == 40
    assert spread(rows, 500, 10_000).rdd.getNumPartitions() == 20
    assert spread(rows, 500).select("id").distinct().count() == 20_000
