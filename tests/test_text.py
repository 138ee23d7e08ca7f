import pytest
from pyspark.sql import functions as F

from leadloom.functions import phones as ph
from leadloom.functions import text as tx
from leadloom.operators import labels


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tel +216 20 111 222", ["+21620111222"]),
        ("Tel 00216 20 111 222", ["+21620111222"]),
        ("Tel 21620111222", ["+21620111222"]),
        ("Tel 20 111 222", ["+21620111222"]),
        ("Tel 20.111.222", ["+21620111222"]),
        ("Tel (20) 111 222", ["+21620111222"]),
        ("Tel 20-111-222", ["+21620111222"]),
        ("Tel 20/111/222", ["+21620111222"]),
        ("☎ ٢٠١١١٢٢٢", ["+21620111222"]),
        ("☎ ۲۰۱۱۱۲۲۲", ["+21620111222"]),
        ("WhatsApp 20 111 222 / 50 333 444", ["+21620111222", "+21650333444"]),
        ("Tél 20 111 222 ou +216 20 111 222", ["+21620111222"]),
        ("Livraison le 12/06/2025 sans téléphone", []),
        ("Tailles 36 38 40 42 disponibles", []),
        ("Prix 20.111 dinars seulement", []),
        ("prix 20 111 222", []),
        ("prix ok, tel: 20 111 222", ["+21620111222"]),
        ("id=123456789012345", []),
        ("Quantité 100 000 pièces", []),
        ("call +1 (212) 555-0100", ["+12125550100"]),
        ("call +1 (112) 555-0100", []),
        ("80 111 222", []),
        ("x20111222", []),
        ("\x01 tel 20 111 222 \x01", ["+21620111222"]),
        ("", []),
        (None, []),
    ],
)
def test_phones(spark, text, want):
    assert [p["e164"] for p in one(spark, ph.phones, text)] == want


def test_phone_fields_and_positions(spark):
    got = one(spark, ph.phones, "ab📞 ٢٠ ١١١ ٢٢٢ et 70-111-222")
    assert [(p["raw"], p["kind"], p["region"], p["valid"]) for p in got] == [
        ("٢٠ ١١١ ٢٢٢", "mobile", "TN", True),
        ("70-111-222", "landline", "TN", True),
    ]
    spans = one(spark, ph.spans, "ab📞 20 111 222")
    assert [(s["start"], s["n"]) for s in spans] == [(4, 10)]


def test_other_countries_and_kinds(spark):
    assert [p["e164"] for p in one(spark, lambda c: ph.phones(c, other_countries=[("41", 9)]), "tel +41 44 111 22 33")] == [
        "+41441112233"
    ]
    assert one(spark, lambda c: ph.phones(c, kinds={"20": "fixed_or_mobile"}), "tel 20 111 222")[0]["kind"] == "fixed_or_mobile"


@pytest.mark.parametrize(
    "text", ["RÉPONSE Straße", "ﬁn ŉ İ ½", "أإآ ؤ ئ", "ǅ ΑΒΓ Σς", "plain", "Ελλάδα ẞ", "é tout près", "ᾳ ﷺ"]
)
def test_fold_and_casefold_equal_python(spark, text):
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    assert one(spark, tx.fold, text) == folded == tx.fold_str(text)
    assert one(spark, tx.casefold, text) == text.casefold()


def test_compact_links_and_lists(spark):
    text = "  a b\t\nc HTTPS://x.example/p). and http://y.example/q، end  "
    assert one(spark, tx.compact_text, text) == "a b c and end"
    assert one(spark, tx.extract_links, text) == ["HTTPS://x.example/p", "http://y.example/q"]
    assert one(spark, tx.extract_links, "none") == []
    lists = spark.createDataFrame([(["b", " ", "a", "b", ""],)], "v array<string>")
    assert lists.select(tx.distinct_non_blank(F.col("v"))).first()[0] == ["b", "a"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call +216 20 111 222 now", "call +216 20 XXX XXX now"),
        ("0021620111222, 20.111.222", "+216 20 XXX XXX, 20 XXX XXX"),
        ("21611222", "+216 21 XXX XXX"),
        ("no phone 123", "no phone 123"),
    ],
)
def test_mask_phones(spark, text, want):
    assert one(spark, tx.mask_phones, text) == want


def test_mask_id_and_json(spark):
    assert one(spark, tx.mask_id, "12345678") == "********"
    assert one(spark, tx.mask_id, "123456789012") == "1234****9012"
    row = spark.range(1).select(tx.intent_json(F.lit("factory"), F.lit(0.5), F.array(F.lit("é")), F.lit("x"))).first()[0]
    assert row == '{"intent":"factory","confidence":0.5,"matched_keywords":["é"],"raw_excerpt":"x"}'


def test_keywords(spark):
    words = ("voir plus de réponses", "عرض الردود")
    for text, want in [("VOIR PLUS DE REPONSES!", True), ("عرض الردود", True), ("other", False), ("", False), (None, False)]:
        assert one(spark, lambda c: tx.matches_any_keyword(c, words), text) is want


def test_match_labels(spark):
    rows = [("View 3  replies",), ("view all comments",), ("hide replies",), ("",), ("view 2 replies " + "x" * 300,)]
    df = spark.createDataFrame(rows, "text string")
    got = labels.match_labels(df, ["all comments"], [r"\bview \d+ repl(y|ies)\b"], ["hide"]).collect()
    assert [r[0] for r in got] == ["View 3  replies", "view all comments"]
    assert labels.match_labels(df, ["view"], limit=1).count() == 1


def test_keyword_groups(spark):
    from leadloom.sources.keywords import load_keyword_groups

    groups = load_keyword_groups()
    assert len(groups.words) == 7 and len(groups.excludes) == 3
    wanted = {
        "view_more_comments": ["Voir plus de commentaires", "عرض المزيد من التعليقات", "See MORE COMMENTS here"],
        "view_replies": ["View 3 replies", "View all replies", "Voir plus de réponses", "Voir les 3 réponses", "عرض الردود"],
        "close_hide": ["Close", "Annuler", "إغلاق"],
        "see_more_text": ["See more", "Voir plus", "عرض المزيد"],
        "sort_all": ["All comments", "كل التعليقات"],
        "sort_current": ["Most relevant", "Newest"],
    }
    rows = [(g, t) for g, texts in wanted.items() for t in texts]
    df = spark.createDataFrame(rows + [("none", "Write a comment"), ("none", "Submit reply")], "g string, text string")
    for g, texts in wanted.items():
        hit = {r["text"] for r in labels.text_matches(df, groups.words[g]).filter("matches").collect()}
        assert set(texts) <= hit and not hit & {"Write a comment", "Submit reply"}
    buttons = labels.match_labels(
        df, groups.words["view_more_comments"], groups.regexes["view_more_comments"], groups.excludes["comments"]
    )
    assert {r["text"] for r in buttons.collect()} == {
        "Voir plus de commentaires", "عرض المزيد من التعليقات", "See MORE COMMENTS here", "عرض المزيد",
    }
