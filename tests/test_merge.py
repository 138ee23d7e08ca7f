"""Folds against a plain sequential model on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import components, merge, posts
from leadloom.session import stored


def model_fold(texts, start, cap):
    acc = start
    for t in texts:
        if acc is None:
            acc = t
            continue
        if not acc:
            acc = t
        elif t not in acc:
            acc = acc + "\n---\n" + t
        acc = acc[-cap:]
    return acc


def random_texts(rng, n, kind):
    if kind == "copies":
        return [rng.choice(["aa", "bb", "cc"]) for _ in range(n)]
    if kind == "distinct":
        return [f"t{rng.randrange(10**6):06d}" * rng.randrange(1, 4) for _ in range(n)]
    pool = [f"w{i}" * rng.randrange(1, 6) for i in range(8)]
    return [rng.choice(pool) if rng.random() < 0.9 else f"u{rng.randrange(10**5)}" for _ in range(n)]


@pytest.mark.parametrize("with_state", [False, True])
def test_raw_text_fold_equals_sequential(spark, with_state):
    rng = random.Random(7)
    cap = 60
    plan = {"small": ("mixed", 5), "copies": ("copies", 80), "distinct": ("distinct", 70), "mixed": ("mixed", 150)}
    per_key = {k: random_texts(rng, n, kind) for k, (kind, n) in plan.items()}
    rows = [(k, i, t) for k, ts in per_key.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "phone_normalized string, seq int, raw_text string")
    start = {"mixed": "old text", "copies": "aa"} if with_state else {}
    state = spark.createDataFrame(list(start.items()), "phone_normalized string, raw_text string") if start else None
    got = {
        r[0]: r[1]
        for r in merge.fold_raw_text(df, state=state, cap=cap, max_rows=10, max_chars=400).collect()
    }
    assert got == {k: model_fold(ts, start.get(k), cap) for k, ts in per_key.items()}


def rounds_of(spark, texts, cap, parts, start=None):
    """Fold one key over ``parts`` range partitions; its text and the number of rounds."""
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, __seq int, __text string")
    stored = None if start is None else spark.createDataFrame([("k", start)], "k string, __initial string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ends, rounds = merge.fold_over_ranges(rows, "k", stored, cap, "raw_text")
        found = ends.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1
    return found[0]["raw_text"], rounds


def test_more_rows_do_not_add_rounds(spark):
    few = [f"text number {i * 7919 % 100_003}" for i in range(400)]
    many = [f"text number {i * 7919 % 100_003}" for i in range(4_000)]
    for texts in (few, many):
        text, rounds = rounds_of(spark, texts, 300, 6)
        assert text == model_fold(texts, None, 300) and rounds <= 2


def test_rounds_stay_within_the_partitions_of_a_key(spark):
    # Few texts, more than the cap together: whether one is known depends on all before it.
    rng = random.Random(5)
    texts = [rng.choice(["aaaa bbbb", "cccc", "dddd eeee f", "gg", "bbbb"]) for _ in range(600)]
    for start in (None, "old text", ""):
        text, rounds = rounds_of(spark, texts, 20, 5, start)
        assert text == model_fold(texts, start, 20) and rounds <= 5


def test_many_keys_share_the_partitions(spark):
    rng = random.Random(6)
    per_key = {f"k{i:02}": random_texts(rng, rng.randrange(1, 90), "mixed") for i in range(30)}
    per_key["hot"] = random_texts(rng, 900, "mixed")
    rows = [(k, i, t) for k, ts in per_key.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    start = {"k03": "old", "hot": "b", "k04": ""}
    frame = spark.createDataFrame(rows, "k string, __seq int, __text string")
    stored = spark.createDataFrame(list(start.items()), "k string, __initial string")
    got = {r["k"]: r["raw_text"] for r in merge.fold_over_ranges(frame, "k", stored, 50, "raw_text")[0].collect()}
    assert got == {k: model_fold(ts, start.get(k), 50) for k, ts in per_key.items()}


def model_posts(rows):
    """Sequential look-up by id, then by link."""
    by_id, by_link, keys = {}, {}, []
    for n, (pid, link) in enumerate(rows):
        if pid and pid in by_id:
            keys.append(by_id[pid])
        elif link and link in by_link:
            keys.append(by_link[link])
        else:
            keys.append(n)
            if pid:
                by_id[pid] = n
            if link:
                by_link[link] = n
    return keys


@pytest.mark.parametrize("fold_pairs", [3, 200_000])
def test_post_identity_equals_sequential(spark, fold_pairs, monkeypatch):
    whole = posts.inserting_pairs
    monkeypatch.setattr(posts, "inserting_pairs", lambda *a: whole(*a, fold_pairs=fold_pairs))
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        pid = rng.choice([None, ""] + [f"p{i}" for i in range(14)])
        link = rng.choice([None] + [f"l{i}" for i in range(14)])
        rows.append((pid, link))
    data = [(p, l, i, f"text {i}") for i, (p, l) in enumerate(rows)]
    df = spark.createDataFrame(data, "post_fb_id string, permalink string, seq int, raw_text string")
    got = posts.resolve_posts(df).orderBy("seq").collect()
    want = model_posts(rows)
    first = {}
    for r, w in zip(got, want):
        assert first.setdefault(w, r["post_key"]) == r["post_key"]
        assert r["was_inserted"] == (w == r["seq"])
    assert len({r["post_key"] for r in got}) == len(set(want))


def test_long_chain_of_ids_and_links_takes_few_rounds(spark, monkeypatch):
    """Each pair shares its id or its link with the one before, so they depend on each other in order."""
    n, cuts = 10_000, []
    rows = [(f"p{(i + 1) // 2}", f"l{i // 2}", i) for i in range(n)]
    monkeypatch.setattr(components, "stored", lambda df: cuts.append(1) or stored(df))
    df = spark.createDataFrame(rows, "post_fb_id string, permalink string, seq int")
    got = sorted(r["at"] for r in posts.inserting_pairs(df).collect())
    # The first pair takes its id and link, which bars the next one; the one after is free again.
    assert got == list(range(0, n, 2))
    # One cut for the edges, then three a round.
    assert (len(cuts) - 1) / 3 <= 15


def test_component_roots(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(1 << 40), rng.randrange(1 << 40)) for _ in range(30)]
    hub = edges[0][0]
    edges += [(hub, rng.randrange(1 << 40)) for _ in range(300)] + [(edges[1][0], edges[2][1]), (5, 5), edges[3][::-1]]
    got = {r["node"]: r["root"] for r in components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for a, b in edges:
        one = groups.setdefault(a, {a}) | groups.setdefault(b, {b})
        groups.update(dict.fromkeys(one, one))
    assert set(got) == set(groups)
    assert {frozenset(g) for g in groups.values()} == {frozenset(n for n in got if got[n] == r) for r in set(got.values())}
    assert all(got[n] in groups[n] for n in got)
    assert components.component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_identity_is_not_transitive(spark):
    df = spark.createDataFrame(
        [("1", "L", 0, "a"), ("2", "L", 1, "b"), ("2", "M", 2, "c")],
        "post_fb_id string, permalink string, seq int, raw_text string",
    )
    rows = posts.resolve_posts(df).orderBy("seq").collect()
    assert rows[0]["post_key"] == rows[1]["post_key"] != rows[2]["post_key"]


def post_rows(spark, rows):
    schema = (
        "post_fb_id string, permalink string, author string, author_fb_id string, timestamp_unix long, "
        "raw_text string, source_group_id string, source_kind string, seq int, seen_at timestamp"
    )
    return spark.createDataFrame(rows, "seq int, post_fb_id string, permalink string, author string, raw_text string").select(
        "post_fb_id", "permalink", "author", F.lit(None).cast("string").alias("author_fb_id"),
        F.lit(None).cast("long").alias("timestamp_unix"), "raw_text", F.lit("g").alias("source_group_id"),
        F.lit("k").alias("source_kind"), "seq", F.timestamp_seconds(F.col("seq") * 60).alias("seen_at"),
    ).to(spark.createDataFrame([], schema).schema)


def test_post_merge_in_two_halves(spark):
    rows = [
        (0, "1", "L", "Ann", "first"), (1, "1", "M", None, ""), (2, None, "L", "Bob", "third"),
        (3, "9", "N", "Cy", ""), (4, "9", None, None, "late"), (5, "8", "N", "Di", "x"),
    ]
    whole = posts.merge_posts(post_rows(spark, rows))
    state = posts.merge_posts(post_rows(spark, rows[:3]))
    halves = posts.merge_posts(post_rows(spark, rows[3:]), state=state)
    a = sorted(map(str, whole.collect()))
    assert a == sorted(map(str, halves.collect()))
    one = [r for r in whole.collect() if r["post_fb_id"] == "1"][0]
    assert (one["permalink"], one["author"], one["raw_text"]) == ("L", "Bob", "third")
    assert whole.count() == 2


def test_first_comment_wins_and_idless_rows_stay(spark):
    df = spark.createDataFrame(
        [("c1", 1, "late"), ("c1", 0, "early"), (None, 2, "a"), (None, 3, "a"), ("", 4, "b"), ("c2", 5, "x")],
        "comment_id string, seq int, text string",
    )
    got = sorted((r["comment_id"] or "", r["text"]) for r in merge.first_per_id(df, "comment_id", "seq").collect())
    assert got == [("", "a"), ("", "a"), ("", "b"), ("c1", "early"), ("c2", "x")]
    state = spark.createDataFrame([("c1",)], "comment_id string")
    again = merge.first_per_id(df, "comment_id", "seq", state)
    assert sorted(r["text"] for r in again.collect()) == ["a", "a", "b", "x"]
