"""Fill-in-the-middle beside a plain version, on odd texts and both kinds of units."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import fill_in_middle as fim


def plain_version(doc_id, text, unit, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    None, "", "\n", "\n\n\n", "a", "a\n", "no end\nof line", "é\nüß\n\n😀x\n漢字", "<P>", "x<S>y\nz", "a<M>", "<P", "P>\n<", "<P\n>",
    "<\nS>\nM>", "\r\n\r\n", "\x00\n\x0b\n", "ÿ\x8a\nĊਊ\n", "line\n" * 5_000, "word " * 200_000, "😀" * 100_001 + "\n", "<<P>>",
]


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice("ab\n\n é漢😀<>PSM") for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("unit, percent, spm", [("line", 100, 50), ("char", 100, 50), ("line", 40, 20)])
def test_equals_plain_version(spark, unit, percent, spm):
    texts = ODD + random_texts(600)
    rows = [(None if i == 3 else i, t, "x", i) for i, t in enumerate(texts)] + [(4, ODD[4], "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n long")
    got = fim.fill_in_middle(docs, unit=unit, percent=percent, spm_percent=spm)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [plain_version(r[0], r[1], unit, 7, percent, spm) for r in rows]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    back = got.select("doc_id", fim.restored().alias("text")).collect()
    assert sorted(((r[0], r[1]) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_empty_table_and_unknown_unit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="page")


def test_marks_agree_with_bytes():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 64, 1_000):
        data = rng.choice(np.array([9, 10, 11, 0, 138, 0x8A, 255, 128], np.uint8), size)
        marks = fim.Marks(fim.mark_byte(fim.as_words(data), 10))
        at = np.flatnonzero(data == 10)
        assert np.array_equal(marks.select(np.arange(len(at))), at)
        assert np.array_equal(marks.rank(np.arange(size + 1)), np.searchsorted(at, np.arange(size + 1)))
        starts = fim.Marks(fim.mark_starts(fim.as_words(data)))
        assert np.array_equal(starts.rank(np.arange(size + 1)), np.searchsorted(np.flatnonzero(data & 0xC0 != 0x80), np.arange(size + 1)))


def test_query_equals_plain_version(spark):
    import os

    from leadloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [plain_version(r[0], r[1], "line")[:5] + (sha(plain_version(r[0], r[1], "line")[5]), sha(r[1] or "")) for r in docs]
    got = QUERIES["op11_fill_in_middle"](spark, sf).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.where(F.col("form") != "plain").count() > 0
