"""Language labels: Viterbi beside all paths, held-out accuracy, spans of mixed texts, odd rows."""

import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import language_id as li

SF = "/root/testdata/sf0.01"


def best_path(scores, switch):
    paths = itertools.product(range(scores.shape[1]), repeat=len(scores))
    value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in paths), value


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    for switch in (0.0, 0.7, 3.0):
        sizes = rng.integers(0, 6, 12)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(size=(bounds[-1], 3))
        scores[rng.random(scores.shape) < 0.2] = -np.inf
        scores[~np.isfinite(scores).any(1)] = 0.0
        labels = li.viterbi(scores, bounds, switch)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b > a:
                best, value = best_path(scores[a:b], switch)
                assert value(labels[a:b]) == pytest.approx(best)


def test_words_are_cut_at_scripts():
    words = li.split_words(pa.array(["Été  don't", "", "漢字kana ﬁ", "привет-мир1", "हिन्दी"]))
    joined = "\n".join(["Été  don't", "", "漢字kana ﬁ", "привет-мир1", "हिन्दी", ""])
    got = [joined[a : a + n] for a, n in zip(words.at.tolist(), words.size.tolist())]
    assert got == ["Été", "don", "t", "漢字", "kana", "ﬁ", "привет", "мир", "हिन्दी"]
    assert words.bounds.tolist() == [0, 3, 3, 6, 8, 9]
    assert [li.SCRIPT_NAMES[s] for s in words.script] == ["latin"] * 3 + ["han", "latin", "latin", "cyrillic", "cyrillic", "devanagari"]


VOCABULARY = {
    "en": "the house with water and thing which through they bright window morning".split(),
    "fr": "été maison avec eau et chose qui à travers élève fenêtre beaucoup matin".split(),
    "ru": "дом вода утро окно через который светлый вещь они".split(),
    "uk": "дім вода ранок вікно через який світлий річ вони її".split(),
    "el": "σπίτι νερό πρωί παράθυρο μέσα πράγμα αυτοί".split(),
}


def made_docs(spark, n=900):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCABULARY))
        text = " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randrange(8, 60)))
        rows.append((i, text.upper() if rng.random() < 0.1 else text, lang if rng.random() < 0.9 else None, "s", 1.0))
    odd = [
        (10_000, None, "en"), (10_001, "", "fr"), (10_002, "123 ... 😀", "en"), (10_003, "漢字 漢字", None), (None, "the water", "en"),
        (5, rows[5][1], rows[5][2]), (10_004, "the window " * 60_000, None), (10_005, "the", None), (10_006, "x" * 300_000, None),
    ]
    return spark.createDataFrame(rows + [(*r, "s", 0.0) for r in odd], "doc_id long, text string, lang string, spans string, score double"), rows


def test_predictions_and_odd_rows(spark):
    docs, rows = made_docs(spark)
    got = li.predicted_languages(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, _, lang, *_ in rows:
        r = by_id[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    told = [(by_id[i]["lang_pred"], lang) for i, _, lang, *_ in rows if lang and by_id[i]["held_out"]]
    assert sum(a == b for a, b in told) / len(told) > 0.97
    for i in (10_000, 10_001, 10_002):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["spans"]) == ("und", 0.0, [])
    assert by_id[10_003]["lang_pred"] in VOCABULARY and by_id[10_003]["score"] == 0 and by_id[10_003]["spans"] == []
    assert by_id[10_004]["lang_pred"] == "en" and [tuple(s) for s in by_id[10_004]["spans"]] == [(0, 659_999, "en")]
    assert by_id[10_005]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "en" and not by_id[None]["held_out"]
    again = {tuple(map(str, r)) for r in got if r["doc_id"] == 5}
    assert len(again) == 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, _ = made_docs(spark, 300)
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(li.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, li.predicted_languages(docs).collect())) == sorted(map(str, li.predicted_languages(other).collect()))


def test_mixed_texts_give_spans(spark):
    docs, _ = made_docs(spark)
    model = li.fit(docs)
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(120):
        parts, at, spans = [], 0, []
        for lang in rng.sample(list(VOCABULARY), rng.randrange(2, 4)):
            part = " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randrange(15, 40)))
            spans.append((at, at + len(part), lang))
            parts.append(part)
            at += len(part) + 1
        rows.append((i, " ".join(parts)))
        want[i] = spans
    got = li.label_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    right = total = 0
    for r in got:
        for a, b, lang in want[r["doc_id"]]:
            total += b - a
            right += sum(max(0, min(b, s["stop"]) - max(a, s["start"])) for s in r["spans"] if s["lang"] == lang)
    assert right / total > 0.95


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the house", None), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted(tuple(r)[:3] for r in li.predicted_languages(docs).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert li.predicted_languages(docs.limit(0)).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    from leadloom.llm.queries import QUERIES

    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    known = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op13_language_id"](spark, SF).collect()
    assert len(got) == len(known)
    told = [r["lang_pred"] == known[r["doc_id"]] for r in got if r["held_out"]]
    assert len(told) > 200 and sum(told) / len(told) > 0.97
