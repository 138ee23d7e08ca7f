"""Periodic runs beside plain searches, on random and periodic words and odd texts."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import periodic_runs as pr


def plain_runs(words, least_words=6, least_repeats=4):
    """All (start, length, period) by looking at every period."""
    n, found = len(words), {}
    for q in range(1, n // least_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least_words, least_repeats * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return rng.choices("ab", k=rng.randrange(80))
    if kind == 1:
        return rng.choices("abc", weights=[8, 1, 1], k=rng.randrange(120))
    if kind == 2:  # periodic inside periodic
        inner = rng.choices("abcd", k=rng.randrange(1, 4)) * rng.randrange(1, 9)
        unit = inner + rng.choices("xyz", k=rng.randrange(3))
        return rng.choices("abxy", k=rng.randrange(6)) + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
    if kind == 3:  # long words of few kinds (Fibonacci words hold runs of many periods)
        a, b = ["a"], ["a", "b"]
        while len(b) < rng.randrange(10, 200):
            a, b = b, b + a
        return b * rng.randrange(1, 6)
    if kind == 4:
        return [str(rng.randrange(1000)) for _ in range(rng.randrange(60))] + ["x"] * rng.randrange(12)
    unit = [str(rng.randrange(50)) for _ in range(rng.randrange(1, 60))]
    words = unit * rng.randrange(1, 8)
    for _ in range(rng.randrange(3)):
        if words:
            words[rng.randrange(len(words))] = "odd"
    return words


def test_equals_plain_search():
    rng = random.Random(3)
    for _ in range(250):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 8))]
        names = {}
        symbols = np.array([names.setdefault(w, len(names)) * 7919 for t in texts for w in t], np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start, stop, period = pr.find_runs(symbols, bounds)
        got = list(zip(start.tolist(), (stop - start).tolist(), period.tolist()))
        want = [(int(bounds[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in plain_runs(t)]
        assert got == want


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = pr.WaveletTree(values, 300)
    lo = rng.integers(0, 300, 200)
    hi = lo + rng.integers(1, 301 - lo)
    bound = rng.integers(0, 301, 200)
    parts = [np.sort(values[a:b]) for a, b in zip(lo, hi)]
    assert tree.count_below(lo, hi, bound).tolist() == [int((p < x).sum()) for p, x in zip(parts, bound)]
    k = np.array([rng.integers(0, len(p)) for p in parts])
    assert tree.smallest(lo, hi, k).tolist() == [int(p[i]) for p, i in zip(parts, k)]


ODD = [
    None, "", "   ", "\t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", " a a  a a a a a ", "a b " * 4, "x " + "a b c " * 4 + "a b",
    "é ü 😀 " * 5, "A a " * 3, "one two " * 30_000, " ".join(str(i) for i in range(50_000)), "w" * 300_000, "a\x1ca " * 6,
]


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words) if len(words) < 2_000 else None
    return words, runs


def test_odd_texts(spark):
    rng = random.Random(9)
    texts = ODD + [" \n".join(some_words(rng)) for _ in range(200)]
    rows = [(None if i == 2 else i, t, i, "runs") for i, t in enumerate(texts)] + [(7, ODD[7], 0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string")
    got = pr.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    out = {(r["doc_id"]): r for r in got.collect()}
    assert got.count() == len(rows) and len(out) == len(texts)
    for doc_id, text, *_ in rows:
        words, runs = expected(text)
        r = out[doc_id]
        assert r["n_words"] == len(words)
        if runs is not None:
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == plain_collapsed(words, runs)
    long = out[ODD.index("one two " * 30_000)]
    assert [tuple(x) for x in long["runs"]] == [(0, 60_000, 2)] and long["collapsed"] == "one two"
    assert out[13]["runs"] == [] and out[13]["collapsed"] == ODD[13]
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, least_repeats=3)


def test_query_equals_plain_search(spark):
    from leadloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
        want.append((doc_id, len(runs), *top, sha(listed), sha(plain_collapsed(words, runs))))
    got = QUERIES["op12_periodic_runs"](spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.where(F.col("n_runs") > 0).count() > 5
