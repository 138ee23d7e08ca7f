import random

import pytest
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import leads as ld
from leadloom.functions import text as tx
from leadloom.operators import intents as it
from leadloom.operators import merge, validation
from leadloom.operators.leads import lead_rows, sightings
from leadloom.plans import queries
from leadloom.sources.rules import load_rules, rule_rows

RULES = load_rules()


def classify(spark, text, rules=RULES, has_phone=True, **kw):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return it.classify_intents(df, rules, has_phone=has_phone, **kw).first()["intent_result"]


def model_classify(text, rules, has_phone):
    """The scoring rules in plain words, for comparison."""
    norm = " ".join(text.split()).casefold()
    score = dict.fromkeys(vocab.INTENTS, 0.0)
    words = {i: [] for i in vocab.INTENTS}
    for r in rules:
        hits = [k for k in r.keywords if k.casefold() in norm]
        barred = any(k.casefold() in norm for k in r.exclude_keywords) or (r.require_phone and not has_phone)
        if hits and not barred:
            score[r.intent] += r.weight * min(len(hits), 2)
            words[r.intent] += hits
    best = max(score, key=lambda i: (score[i], vocab.INTENT_PRIORITY[i]))
    if score[best] <= 0:
        return "other", 0.0, []
    return best, score[best] / sum(score.values()), list(dict.fromkeys(words[best]))


def test_bundled_rules():
    assert len(RULES) == 20
    assert {r.language for r in RULES} == {"ar", "tn", "fr", "en"}
    assert sum(len(r.keywords) for r in RULES) == 169


def test_rule_rows():
    rows = rule_rows({"languages": {"fr": [{"intent": "factory", "keywords": ["a", " "]}, "bad"], "x": "bad"}})
    assert rows == (it.IntentRule("factory", "fr", ("a",), 1.0, False, ()),)
    with pytest.raises(ValueError):
        rule_rows({"languages": {"fr": [{"intent": "nonsense"}]}})
    with pytest.raises(ValueError):
        rule_rows({"languages": []})
    assert rule_rows(None) == ()


def test_evidence(spark):
    got = classify(spark, "Grossiste tissu popeline satin. Tel 70 111 222")
    assert got["intent"] == "fabric_supplier" and got["confidence"] > 0 and "tissu" in got["matched_keywords"]
    assert classify(spark, "rien du tout") == ("other", 0.0, [], "rien du tout")


def test_excerpt_is_cut_on_both_sides(spark):
    got = classify(spark, "x" * 100 + " ATELIER " + "y" * 100)["raw_excerpt"]
    assert got == "…" + "x" * 59 + " ATELIER " + "y" * 59 + "…"


def random_cases():
    rng = random.Random(5)
    bits = ["atelier", "couture", "usine", "Straße", "tissu", "for sale", "satin", "ß", "façon", "é", "zz"]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(0, 7))) for _ in range(60)]
    rules = [
        it.IntentRule(rng.choice(vocab.INTENTS), "x", tuple(rng.choices(bits, k=3)), rng.choice([1.0, 2.0, 3.5]),
                      rng.random() < 0.3, tuple(rng.choices(bits, k=1)) if rng.random() < 0.3 else ())
        for _ in range(12)
    ]
    return texts, rules


@pytest.mark.parametrize("max_literal", [2_000, 0])
def test_literal_and_automaton_forms_equal_the_model(spark, max_literal):
    texts, rules = random_cases()
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "id long, text string, phone boolean")
    rows = it.classify_intents(
        df, rules, has_phone=F.col("phone"), max_literal_keywords=max_literal
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        intent, confidence, words = model_classify(texts[r["id"]], rules, r["phone"])
        got = r["intent_result"]
        assert (got["intent"], got["matched_keywords"]) == (intent, words), texts[r["id"]]
        assert abs(got["confidence"] - confidence) <= 0.0005


def expr(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(f(*[F.col(c) for c in cols])).first()[0]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Atelier Lina couture. Tel 1", "Lina couture"),
        ("contact Jo", None),
        ("أنا سلمى من سوسة", "سلمى من سوسة"),
        ("Nom: Sami Doe! ok", "Sami Doe"),
        ("chez Hotel X", "Ho"),
        ("nothing here", None),
    ],
)
def test_names(spark, text, name):
    assert expr(spark, ld.extract_name, text) == name


def test_what_and_why(spark):
    text = "Bonjour à tous. ATELIER à Sousse! Je cherche des clients؟ Merci"
    assert expr(spark, lambda c: ld.extract_what(c, F.lit("x")), text) == "ATELIER à Sousse!"
    assert expr(spark, ld.extract_why, text) == "Je cherche des clients؟"
    assert expr(spark, lambda c: ld.extract_what(c, F.lit("x")), "") == "Detected intent: x"
    assert expr(spark, ld.extract_why, "") == "Not explicitly stated"
    assert len(expr(spark, ld.extract_why, "a" * 400)) == 280


@pytest.mark.parametrize(
    ("text", "link", "permalink", "want"),
    [
        ("see http://a.example/x", None, None, ["http://a.example/x"]),
        ("see http://a.example/x", "L", "P", ["P", "L", "http://a.example/x"]),
        ("see http://a.example/x", "L", "http://a.example/x", ["L", "http://a.example/x"]),
        ("none", "L", "L", ["L"]),
        ("none", "", "", []),
    ],
)
def test_link_order(spark, text, link, permalink, want):
    assert expr(spark, ld.lead_links, text, link, permalink) == want


POSTS = [
    (0, "Atelier couture. Tel 20 111 222", "https://x.example/0"),
    (1, "no phone, atelier", None),
    (2, "Usine textile. Tel 20 111 222 / 50 333 444", None),
]


def post_frame(spark, rows=POSTS):
    df = spark.createDataFrame(rows, "post_order long, text string, link string")
    return df.select("*", F.lit("g").alias("source_group_id"), F.timestamp_seconds(F.col("post_order") * 60).alias("seen_at"))


def test_one_row_per_phone(spark):
    rows = lead_rows(post_frame(spark), RULES, keep=["post_order"]).orderBy("post_order", "phone_pos").collect()
    assert [(r["post_order"], r["phone_normalized"]) for r in rows] == [
        (0, "+21620111222"), (2, "+21620111222"), (2, "+21650333444"),
    ]
    assert rows[0]["author"] is None and rows[0]["links"] == ["https://x.example/0"]


def test_merge_whole_equals_two_batches(spark):
    comments = post_frame(spark, [(0, "Tel 50 333 444 recrute", None), (1, "prix? tel 90 111 222", None)]).select(
        "*", F.lit(1).cast("long").alias("comment_order"), F.lit("Ann").alias("author"), F.lit("P").alias("permalink"),
        F.lit(7).cast("long").alias("timestamp_unix"),
    )
    whole = merge.merge_leads(sightings(post_frame(spark), comments, RULES))
    first = merge.merge_leads(sightings(post_frame(spark, POSTS[:2]), comments, RULES, batch_no=0))
    rows = {r["phone_normalized"]: r for r in whole.collect()}
    assert rows["+21620111222"]["post_count"] == 2
    assert rows["+21650333444"]["author"] == "Ann"
    both = merge.merge_leads(sightings(post_frame(spark, POSTS[2:]), None, RULES, batch_no=1), state=first)
    counts = {r["phone_normalized"]: (r["post_count"], r["raw_text"]) for r in both.collect()}
    assert counts["+21620111222"][0] == 2 and "\n---\n" in counts["+21620111222"][1]
    assert counts["+21650333444"][0] == 2 and counts["+21690111222"][0] == 1
    found = sightings(post_frame(spark), None, RULES)
    assert merge.upsert_counts(found).first() == (2, 1)
    assert merge.upsert_counts(found, first).first() == (0, 3)


def test_links_in_batches_and_long_lists(spark):
    def found(batch, rows):
        df = spark.createDataFrame([(p, i, ls) for i, (p, ls) in enumerate(rows)], "phone_normalized string, n int, links array<string>")
        return df.select("phone_normalized", F.struct(F.lit(batch).alias("b"), "n").alias("seq"), "links")

    first = merge.distinct_links(found(0, [("a", ["x", " ", "y"]), ("b", ["q"]), ("a", ["y", "z"])]))
    both = merge.distinct_links(found(1, [("a", ["w", "x"]), ("c", [])]), state=first)
    leads = spark.createDataFrame([("a",), ("b",), ("c",)], "phone_normalized string")
    got = {r[0]: r[1] for r in merge.with_link_lists(leads, both).collect()}
    assert got == {"a": ["x", "y", "z", "w"], "b": ["q"], "c": []}


def test_validation(spark):
    expected = spark.createDataFrame(
        [("a", ["+1"], "factory", 1), ("b", ["+1", "+2"], "factory", 2), ("c", [], "other", 0), ("d", [], "other", 0)],
        "id string, expected_phones array<string>, expected_intent string, expected_leads long",
    )
    actual = spark.createDataFrame(
        [("a", "+1", "factory"), ("b", "+2", "factory"), ("b", "+1", "atelier"), ("d", "+3", "other")],
        "id string, phone_normalized string, intent string",
    )
    checked = validation.validate(expected, actual)
    assert {r["id"]: r["passed"] for r in checked.collect()} == {"a": True, "b": False, "c": True, "d": False}
    assert validation.validation_totals(checked).first() == (4, 2)
    assert tx.casefold_str("ẞ") == "ss"


def test_large_rule_table_needs_no_key(spark):
    rules = [it.IntentRule("factory", "x", tuple(f"word{i:04d}" for i in range(3_000)), 1.0), *RULES]
    posts = post_frame(spark)
    found = [sightings(posts, None, r).orderBy("seq").collect() for r in (RULES, rules)]
    assert found[0] == found[1] and found[0]


def test_order_columns_have_to_be_numbers(spark):
    posts = post_frame(spark).withColumn("post_order", F.lit("first"))
    with pytest.raises(Exception, match="post_order has to be a whole number"):
        sightings(posts, None, RULES).collect()


def test_empty_values_stay_empty(spark):
    rows = [("a", 1, ""), ("a", 2, ""), ("b", 1, None), ("b", 2, ""), ("c", 1, ""), ("c", 2, "x"), ("c", 3, "")]
    df = spark.createDataFrame(rows, "phone_normalized string, seq long, name string").select(
        "*", F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"),
        F.lit(1).cast("long").alias("post_count"), F.lit("i").alias("intent"),
    )
    got = merge.fold_scalars(df, last_non_empty=("name",), last=("intent",), last_non_null=())
    assert {r["phone_normalized"]: r["name"] for r in got.collect()} == {"a": "", "b": None, "c": "x"}


def _rule_documents(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["USINE recrute", "fabric for sale, hiring", None])]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bundled_rules_look_at_each_text_once(spark, tmp_path):
    hits = queries.bundled_rule_rows(spark, _rule_documents(spark, tmp_path))
    # Bound once inside the rules, and by no filter below the generator.
    assert _plan(hits).count("lower(") == 1
    found = {(r["intent"], r["words"]) for r in hits.filter("doc_id = 0").collect()}
    assert ("job_offer", "recrute") in found and ("factory", "usine") in found


def test_bundled_scores_are_computed_by_no_filter(spark, tmp_path):
    scores = queries.bundled_rule_scores(spark, _rule_documents(spark, tmp_path))
    assert "Filter" not in _plan(scores)
    assert scores.count() == 3 * len(vocab.INTENTS)
    assert {r["doc_id"] for r in scores.filter("score > 0 and best").collect()} >= {0}
