import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from leadloom import schemas
from leadloom.operators import activity, ranking, reports, threads
from leadloom.plans import jobs
from leadloom.sources import pages as pg
from leadloom.sources import sinks, tables
from leadloom.sources.store import Conflict, Tables
from leadloom.sources.rules import load_rules
from leadloom.streaming import merge as streaming

RULES = load_rules()
PAGE = """<html><body>
<article data-post-id="a1"><p>Atelier couture. Tel 20 111 222</p><a href="/p/a1">link</a></article>
<article data-post-id="a2"><p>Usine textile recrute. Tel 20 111 222 / 50 333 444</p></article>
<article data-post-id="a3"><p>Grossiste tissu sans telephone ni rien</p></article></body></html>"""


def stored_pages(spark, html=PAGE):
    return spark.createDataFrame([(1, html)], "page_id long, html string").withColumn(
        "captured_at", F.lit("2025-01-20 12:00:00").cast("timestamp")
    )


def csv_text(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(path + "/part-*")))


def test_ingest_report_and_export(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path / "state"))
    first = jobs.ingest_pages(store, stored_pages(spark), RULES, "g1")
    assert first == {
        "posts_fetched": 3, "posts_parsed": 3, "leads_inserted": 2, "leads_skipped_duplicate": 1, "status": "cache_only",
    }
    again = jobs.ingest_pages(store, stored_pages(spark), RULES, "g1", limit=1)
    assert (again["leads_inserted"], again["leads_skipped_duplicate"]) == (0, 1)
    leads = store.read("leads", schemas.LEADS)
    counts = {r["phone_normalized"]: r["post_count"] for r in leads.collect()}
    assert counts == {"+21620111222": 3, "+21650333444": 1}

    stats = reports.stats(leads, store.runs())
    assert stats["total_leads"].first()[0] == 2
    assert {r["prefix"]: r["count"] for r in stats["by_phone_prefix"].collect()} == {"20": 1, "50": 1}
    assert stats["runs_by_mode"].first() == ("cached", 2)
    assert stats["last_runs"].first()["last_run"]["posts_requested"] == 1

    masked = csv_text(jobs.export_job(store, str(tmp_path / "out"), "csv"))
    assert masked.splitlines()[0].startswith("id,phone_raw,phone_normalized,name,what,why,intent,")
    assert "+216 20 XXX XXX" in masked and "111 222" not in masked and "111222" not in masked
    clear = csv_text(jobs.export_job(store, str(tmp_path / "out2"), "csv", mask=False, limit=1))
    assert "+21620111222" in clear
    path = jobs.export_job(store, str(tmp_path / "out3"), "json", intent="job_offer", mask=False)
    assert "leads_job_offer_" in path
    rows = [json.loads(line) for line in csv_text(path).splitlines()]
    assert rows and {r["intent"] for r in rows} == {"job_offer"} and len(rows[0]) == 21
    with pytest.raises(ValueError):
        jobs.export_job(store, str(tmp_path / "out4"), since="20 May")
    with pytest.raises(ValueError):
        sinks.export_leads(leads, store.read("lead_links", schemas.LEAD_LINKS), str(tmp_path), "xml")
    path = sinks.export_leads(leads, store.read("lead_links", schemas.LEAD_LINKS), str(tmp_path / "out5"), "json")
    listed = {r["id"]: r["links"] for r in map(json.loads, csv_text(path).splitlines())}
    linked = {r["id"] for r in map(json.loads, csv_text(path + "_links").splitlines())}
    assert linked == {i for i, links in listed.items() if links}
    assert store.vacuum(keep=1) == [0] and store.versions() == [1]
    assert store.read("leads", schemas.LEADS).count() == 2 and store.read("leads", schemas.LEADS, version=0) is None


def test_pages_without_posts(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path))
    assert jobs.ingest_pages(store, stored_pages(spark, "<html></html>"), RULES, "g")["status"] == "empty_or_markup_changed"
    assert store.runs().first()["status"] == "empty_or_markup_changed"


def test_failures_are_recorded(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path))
    with pytest.raises(Exception):
        jobs.ingest_pages(store, stored_pages(spark).drop("captured_at"), RULES, "g")
    run = store.runs().first()
    assert run["status"] == "parser_error" and run["error_class"]


def posts_and_comments(spark):
    posts = spark.createDataFrame(
        [("r1", 0, "p1", "L1", "Atelier couture Tel 20 111 222"), ("r2", 1, "p1", "L1", "again"), ("r3", 2, None, "L3", "x")],
        "post_ref string, post_order long, post_fb_id string, permalink string, text string",
    ).select(
        "*", F.lit("Ann").alias("author"), F.lit(None).cast("string").alias("author_fb_id"),
        F.lit(1).cast("long").alias("timestamp_unix"), F.lit("2025-01-20").cast("timestamp").alias("seen_at"),
    )
    comments = spark.createDataFrame(
        [("r1", 0, "c1", None, "tel 50 333 444"), ("r1", 1, "c2", "c1", "reply"), ("r3", 0, "c1", None, "late twin"),
         ("r3", 1, None, None, "no id")],
        "post_ref string, comment_order long, comment_id string, parent_comment_id string, text string",
    ).select(
        "*", F.lit("Bob").alias("author"), F.lit(None).cast("string").alias("author_fb_id"),
        F.lit(5).cast("long").alias("timestamp_unix"), F.lit(False).alias("is_reply"),
        F.lit("2025-01-21").cast("timestamp").alias("captured_at"),
    )
    return posts, comments


def test_posts_and_comments_job(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path))
    posts, comments = posts_and_comments(spark)
    got = jobs.ingest_posts_and_comments(store, posts, comments, RULES, "g")
    assert (got["posts_fetched"], got["comment_attempts"], got["comments_inserted"], got["leads_inserted"]) == (3, 4, 3, 2)
    again = jobs.ingest_posts_and_comments(store, posts, comments, RULES, "g")
    assert (again["comments_inserted"], again["leads_inserted"], again["leads_skipped_duplicate"]) == (1, 0, 2)
    kept_posts, kept = store.read("posts", schemas.POSTS), store.read("comments", schemas.COMMENTS)
    assert kept_posts.count() == 2 and kept.count() == 4
    bundle = reports.report_bundle(store.read("leads", schemas.LEADS), kept_posts, kept, store.runs())
    assert {k: v.count() for k, v in bundle.items()} == {
        "total_leads": 1, "by_intent": 2, "by_phone_prefix": 2, "runs_by_mode": 1, "last_runs": 1, "total_posts": 1,
        "total_comments": 1, "top_contacts": 2, "posts": 2, "comments": 4, "runs": 2,
    }
    parents = threads.resolve_parents(kept).filter("parent_key is not null").collect()
    assert [(r["comment_id"], r["parent_key"]) for r in parents] == [("c2", "c1")]


def test_group_pages_job(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path))
    html = (
        '<div role="article"><h2><strong>Ann</strong></h2><div data-ad-preview="message"><div>Atelier Tel 20 111 222</div></div></div>'
        '<ul><li><div role="article" data-commentid="c1"><a href="/user/2"><span>Bob</span></a>'
        '<div dir="auto" style="text-align: start;">appelez 50 333 444</div></div></li></ul>'
    )
    pages = stored_pages(spark, html).withColumn("url", F.lit("https://www.facebook.com/groups/1/posts/42"))
    got = jobs.ingest_group_pages(store, pages, RULES, "g")
    assert (got["posts_fetched"], got["comments_inserted"], got["leads_inserted"], got["comments_without_post"]) == (1, 1, 2, 0)
    assert store.read("posts", schemas.POSTS).first()["post_fb_id"] == "42"
    with pytest.raises(Exception):
        jobs.ingest_group_pages(store, pages.drop("captured_at"), RULES, "g")
    assert store.runs().filter("status = 'parser_error'").count() == 1


def test_thread_order_and_ranks(spark):
    rows = [("p", f"c{i}", None if i % 3 else "c1", (i * 7) % 5 if i % 4 else None) for i in range(40)] + [("q", "z", None, 1)]
    df = spark.createDataFrame(rows, "post_key string, comment_key string, parent_comment_id string, timestamp_unix long")
    got = {(r["post_key"], r["comment_key"]): r["position"] for r in threads.threads(df).collect()}
    order = sorted(
        (r for r in rows if r[0] == "p"), key=lambda r: (r[2] is not None, r[3] or 0, r[1])
    )
    assert [got[("p", r[1])] for r in order] == list(range(1, 41)) and got[("q", "z")] == 1
    assert [r["comment_key"] for r in threads.thread(df, "p").collect()] == [r[1] for r in order]
    blocks = ranking.blocks_within_key(df, ["post_key"], ["comment_key"], 5)
    assert blocks.groupBy("post_key", "__block").count().agg(F.max("count")).first()[0] <= 5


def test_trailing_activity(spark):
    times = [0, 10, 59, 60, 60, 61, 120, 200]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)], "source string, event_id long, t long")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = {r["event_id"]: (r["in_window"], r["seconds_to_next_slot"]) for r in activity.trailing_activity(df, cap=3).collect()}
    for i, t in enumerate(times):
        before = [u for u in times[:i] if u >= t - 60]
        assert got[i] == (len(before), 0.0 if len(before) < 3 else max(0.0, before[0] + 60.0 - t))
    dense = spark.range(200_000).select(F.lit("s").alias("source"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 100).alias("ts"))
    assert activity.trailing_activity(dense, seconds=10).filter("in_window <> least(event_id, 100000)").count() == 0
    # Rows without a time drop out; those without a source are a source of their own; other columns stay, clashing names too.
    rows = [(None, 1, 0, "a"), (None, 2, 5, "b"), ("s", 3, None, "c"), ("s", 4, 5, "d"), ("s", 4, 5, "e")]
    odd = spark.createDataFrame(rows, "source string, event_id long, t long, n string").withColumn("ts", F.timestamp_seconds("t"))
    found = activity.trailing_activity(odd).select("source", "n", "in_window").collect()
    assert sorted((r["source"] or "", r["in_window"]) for r in found) == [("", 0), ("", 1), ("s", 0), ("s", 1)]
    assert sorted(r["n"] for r in found) == ["a", "b", "d", "e"] and activity.trailing_activity(odd.limit(0)).count() == 0
    gap = activity.mean_gap(df).first()
    assert gap["n"] == 8 and gap["mean_gap_seconds"] == pytest.approx(200 / 7)


def test_runs_are_checked(spark, tmp_path):
    run = {"source_mode": "live", "status": "blocked", "error_detail": "x" * 3000}
    one = spark.createDataFrame([run], "source_mode string, status string, error_detail string")
    sinks.append_runs(one, str(tmp_path / "runs"))
    kept = spark.read.parquet(str(tmp_path / "runs")).first()
    assert len(kept["error_detail"]) == 2000 and kept["run_id"]
    for bad in ({"source_mode": "x"}, {"status": "y"}):
        frame = spark.createDataFrame([{**run, **bad}], "source_mode string, status string, error_detail string")
        with pytest.raises(Exception, match="invalid"):
            sinks.checked_runs(frame).collect()


def test_old_tables_are_read(spark, tmp_path):
    old = spark.createDataFrame([("+2162", 1)], "phone_normalized string, post_count int")
    old.write.parquet(str(tmp_path / "old"))
    row = tables.read_table(spark, str(tmp_path / "old"), schemas.LEADS).first()
    assert row["post_count"] == 1 and row["permalink"] is None
    assert not schemas.is_compatible(old.columns) and schemas.is_compatible(schemas.LEADS.names)


def test_sources(spark, tmp_path):
    post = {"id": "a", "text": "Tel 20 111 222", "expected_phones": ["+21620111222"], "expected_intent": "other", "expected_leads": 1}
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.json").write_text(json.dumps(post, indent=1), encoding="utf-8")
    assert tables.read_post_files(spark, str(tmp_path / "posts")).first()["expected_phones"] == ["+21620111222"]
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text(PAGE, encoding="utf-8")
    assert pg.load_pages(spark, str(tmp_path / "html"), as_text=True).first()["html"] == PAGE
    sinks.archive_pages(stored_pages(spark), str(tmp_path / "land"))
    assert os.listdir(tmp_path / "land" / "fetch_date=2025-01-20")


STREAM = "post_order long, text string, link string, source_group_id string, seen_at timestamp"


def test_lead_stream_equals_batch_and_replays(spark, tmp_path):
    texts = ["Atelier Tel 20 111 222", "Usine Tel 20 111 222", "recrute tel 50 333 444", "rien"]
    src = str(tmp_path / "in")
    for i, text in enumerate(texts):
        spark.createDataFrame([(i, text)], "i long, t string").select(
            F.col("i").alias("post_order"), F.col("t").alias("text"), F.lit(None).cast("string").alias("link"),
            F.lit("g").alias("source_group_id"), F.timestamp_seconds(F.col("i")).alias("seen_at"),
        ).coalesce(1).write.mode("append").parquet(src)
    store = jobs.Tables(spark, str(tmp_path / "state"))
    posts = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 2).parquet(src)
    query = streaming.stream_leads(posts, store, RULES, str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["phone_normalized"]: r["post_count"] for r in store.read("leads", schemas.LEADS).collect()}
    assert got == {"+21620111222": 2, "+21650333444": 1}
    batch = spark.read.parquet(src)
    checkpoint = str(tmp_path / "ckpt")
    assert streaming.merge_batch(store, batch, 1, RULES, checkpoint) is False
    assert streaming.merge_batch(store, batch, 1, RULES, "another stream") is True
    # A job in between takes a version of its own and hides no batch.
    assert jobs.ingest_pages(store, stored_pages(spark), RULES, "g1")["leads_skipped_duplicate"] == 3
    assert streaming.merge_batch(store, batch, 2, RULES, "another stream") is True
    assert streaming.merge_batch(store, batch, 2, RULES, "another stream") is False
    counts = {r["phone_normalized"]: r["post_count"] for r in store.read("leads", schemas.LEADS).collect()}
    assert counts == {"+21620111222": 2 + 2 + 2 + 2, "+21650333444": 1 + 1 + 1 + 1}


def test_stream_after_a_job_keeps_its_first_batch(spark, tmp_path):
    store = jobs.Tables(spark, str(tmp_path / "state"))
    jobs.ingest_pages(store, stored_pages(spark), RULES, "g1")
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, "Tel 50 777 888")], "post_order long, text string").select(
        "*", F.lit(None).cast("string").alias("link"), F.lit("g").alias("source_group_id"), F.timestamp_seconds(F.lit(1)).alias("seen_at")
    ).write.parquet(src)
    for name in ("one", "two"):  # a new checkpoint counts from batch 0 again
        posts = spark.readStream.schema(STREAM).parquet(src)
        streaming.stream_leads(posts, store, RULES, str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    counts = {r["phone_normalized"]: r["post_count"] for r in store.read("leads", schemas.LEADS).collect()}
    assert counts["+21650777888"] == 2


def test_comment_stream_keeps_first(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "comment_id string, text string, captured_at timestamp"
    rows = [("c1", "first", 1), ("c1", "second", 2), (None, "a", 3), (None, "a", 4), ("c2", "x", 5)]
    for cid, text, at in rows:
        spark.createDataFrame([(cid, text, at)], "comment_id string, text string, t long").select(
            "comment_id", "text", F.timestamp_seconds("t").alias("captured_at")
        ).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    query = (
        streaming.stream_first_comments(stream).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted((r["comment_id"] or "", r["text"]) for r in spark.read.parquet(out).collect()) == [
        ("", "a"), ("", "a"), ("c1", "first"), ("c2", "x"),
    ]


def lead_posts(spark, *rows):
    return spark.createDataFrame(list(rows), "post_order long, text string").select(
        "*", F.lit(None).cast("string").alias("link"), F.lit("g").alias("source_group_id"), F.timestamp_seconds(F.lit(1)).alias("seen_at")
    )


def test_a_one_phone_batch_writes_one_bucket(spark, tmp_path):
    store = Tables(spark, str(tmp_path), buckets=8)
    texts = [(i, f"Atelier Tel 20 111 {i:03d}") for i in range(100, 140)]
    assert streaming.merge_batch(store, lead_posts(spark, *texts), 0, RULES)
    before = store.snapshot()
    assert set(before.paths["leads"]) == {-1, *range(8)} and before.buckets == 8
    assert streaming.merge_batch(Tables(spark, str(tmp_path)), lead_posts(spark, (1, "Tel 20 111 105")), 1, RULES)
    after = store.snapshot()
    changed = [b for b, path in after.paths["leads"].items() if path != before.paths["leads"][b]]
    assert len(changed) == 1 and after.buckets == 8 and after.paths["lead_links"] == before.paths["lead_links"]
    counts = {r["phone_normalized"]: r["post_count"] for r in store.read("leads", schemas.LEADS).collect()}
    assert len(counts) == 40 and counts.pop("+21620111105") == 2 and set(counts.values()) == {1}
    # The version before stays readable until it is cleared; what both share stays after that.
    assert store.read("leads", schemas.LEADS, before.version).agg(F.sum("post_count")).first()[0] == 40
    store.vacuum(keep=1)
    assert store.read("leads", schemas.LEADS).agg(F.sum("post_count")).first()[0] == 41


def test_a_killed_job_leaves_the_set_before(spark, tmp_path, monkeypatch):
    store = Tables(spark, str(tmp_path), buckets=2)
    posts, comments = posts_and_comments(spark)
    jobs.ingest_posts_and_comments(store, posts, comments, RULES, "g")
    names = {"posts": schemas.POSTS, "comments": schemas.COMMENTS, "leads": schemas.LEADS, "lead_links": schemas.LEAD_LINKS}

    def state():
        return {n: sorted(map(str, store.read(n, s).drop("first_at").collect())) for n, s in names.items()}

    before = state()
    with monkeypatch.context() as patched:
        # It ends after posts, comments and leads were written, before the links.
        patched.setattr(jobs, "distinct_links", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.ingest_posts_and_comments(store, posts, comments, RULES, "g")
    assert state() == before and store.versions() == [0]
    failed = store.runs().filter("status = 'parser_error'").collect()
    assert [r["error_class"] for r in failed] == ["ZeroDivisionError"]
    again = jobs.ingest_posts_and_comments(store, posts, comments, RULES, "g")
    assert (again["leads_inserted"], again["leads_skipped_duplicate"], again["comments_inserted"]) == (0, 2, 1)
    assert store.versions() == [0, 1]


def test_of_two_changes_one_stands(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    one, other = store.change(), store.change()
    for change, value in ((one, 1), (other, 2)):
        change.replace("t", spark.createDataFrame([(value,)], "x long"))
    one.commit()
    with pytest.raises(Conflict):
        other.commit()
    rows = store.read("t", schemas._schema("x bigint")).collect()
    assert [r["x"] for r in rows] == [1] and store.versions() == [0]
    assert not store.has_folded("s", 0)
