"""Packing: pieces against the tokenizer itself, plans against exhaustive search, places without gaps."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import packing
from leadloom.llm.queries import tokenizer_path

TEXTS = [
    "", "don't .'s x's 'S!.'s", "Hello, World!! a1b2-c3", "<|endoftext|> A<|ENDOFTEXT|>", "İstanbul ΑΣ. éa  x y\x1cz",
    '###token = "abc"', "\U0001f600!a", " \n\t ", "éa ,́ b≠c", "word " * 5_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizers(tokenizer):
    coder = packing.WordIds(tokenizer_path())
    for texts in (TEXTS, [t for t in TEXTS if "<|" not in t], TEXTS):
        ids, at = coder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_full_cache_starts_over(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    coder = packing.WordIds(tokenizer_path())
    for text in ("one two three", "four five", "one two six seven eight"):
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(150):
        counts = Counter(rng.choices(range(1, 12), k=rng.randrange(1, 8)))
        room = rng.randrange(0, 25)
        own = packing.fullest(sorted(counts, reverse=True), counts, room)
        sums = {0}
        for length in counts.elements():
            sums |= {s + length for s in sums if s + length <= room}
        assert sum(own) == max(sums) and all(n <= counts[x] for x, n in Counter(own).items())


def test_bins_hold_all_and_are_few():
    rng = random.Random(4)
    histogram = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    bins = packing.minimum_bin_slack(histogram)
    placed = Counter()
    for own, times in bins:
        assert sum(own) <= 2048
        placed.update({x: n * times for x, n in Counter(own).items()})
    assert placed == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert sum(times for _, times in bins) <= least * 1.002 + 1
    assert packing.minimum_bin_slack({}) == [] and len(packing.placement([])["key"]) == 0


def test_packed_documents(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, piece string, length int")
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
