"""Near-dedup, passages and suffix dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leadloom.llm import arrays, order_minhash, substring_dedup, suffix_dedup
from leadloom.llm.components import connected_components

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "nar pel rit son tus vak wem xio yul zad".split()]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, digest string, n int")
    return df.repartition(3)


# ---- components -------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(1_000, 1_060)] + [(3, 3), (None, 4)]
    root = {x: x for pair in links for x in pair if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near-dedup -------------------------------------------------------------------


def plain_common(a, b, width):
    best = np.zeros((len(b) + 1, len(a) + 1), int)
    for i in range(len(b)):
        for j in range(len(a)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[j] == b[i] and abs(i - j) <= width))
    return best[-1, -1]


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(400):
        k = rng.choice([2, 4, 9])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(14))] for _ in range(2))
        width = rng.randrange(15)
        assert order_minhash.aligned(a, b, width) == plain_common(a, b, width)


def edited(rng, words, share):
    out = []
    for w in words:
        dice = rng.random()
        if dice < share / 3:
            continue
        out.append(rng.choice(WORDS) if dice < share * 2 / 3 else w)
        if dice > 1 - share / 3:
            out.append(rng.choice(WORDS))
    return out


def near_docs():
    rng = random.Random(3)
    docs, i = [], 100
    for _ in range(25):
        base = prose(rng, rng.randrange(40, 200))
        for share in (0, 0, 0.03, 0.05, rng.choice([0.5, 0.7])):
            i += rng.randrange(1, 5)
            docs.append((i, " ".join(edited(rng, base, share))))
    # A line that many short, unlike documents share, and one large group of near copies.
    line = " ".join(prose(rng, 14))
    docs += [(5_000 + k, " ".join(prose(rng, 12)) + " " + line) for k in range(150)]
    base = prose(rng, 80)
    docs += [(9_000 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(80)]
    docs += [(20, ""), (21, "  \n"), (22, "?!"), (23, "?!"), (24, None), (25, "One, TWO three"), (26, "one two (three)"), (27, "one two four")]
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = near_docs()
    rows = frame(spark, docs + [(None, "one two three"), (None, "no such text anywhere"), docs[0]])
    got = [r.asDict() for r in order_minhash.near_duplicates(rows).collect()]
    words, _, _, at = order_minhash.word_runs(pa.array([t or "" for _, t in docs]))
    own = [words[a:b] for a, b in zip(at[:-1], at[1:])]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(own[i]) and len(own[j]):
                n, m = len(own[i]), len(own[j])
                same = min(n, m) >= 0.8 * max(n, m) and plain_or_fast(own[i], own[j]) >= 0.8 * max(n, m)
            else:
                same = not len(own[i]) and not len(own[j]) and (docs[i][1] or "") == (docs[j][1] or "")
            # Texts of fewer words than a shingle are alike only if equal.
            if same and min(len(own[i]), len(own[j])) < 6:
                same = len(own[i]) == len(own[j]) and (own[i] == own[j]).all()
            if same:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: docs[k][0])] = min(a, b, key=lambda k: docs[k][0])
    want = {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}
    named = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert named == want
    assert sorted(repr(r["class_id"]) for r in got if r["doc_id"] is None) == ["25", "None"]
    sizes = Counter(repr(r["class_id"]) for r in got)
    assert all(r["class_size"] == sizes[repr(r["class_id"])] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    kept = order_minhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) | {None}
    assert order_minhash.near_duplicates(rows.limit(0)).count() == 0


def plain_or_fast(a, b):
    if not set(a.tolist()) & set(b.tolist()):
        return 0
    return order_minhash.aligned(a.tolist(), b.tolist(), max(len(a), len(b)))


def test_large_rests_split_and_end(spark, monkeypatch):
    """With tiny limits every kind of round is taken; the classes stay those of the usual limits."""
    rows = frame(spark, near_docs())
    usual = sorted(order_minhash.near_duplicates(rows).select("doc_id", "class_id").collect())
    monkeypatch.setattr(order_minhash, "SMALL", 2)
    assert sorted(order_minhash.near_duplicates(rows).select("doc_id", "class_id").collect()) == usual


def substituted(rng, words, n):
    places = set(rng.sample(range(len(words)), n))
    return [f"new{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]


def test_links_by_way_of_members_that_are_similar_to_the_leader(spark):
    """The leader is similar to B, B to C, the leader not to C; all three share their only bucket, with others or alone."""
    rng = random.Random(13)
    base = prose(rng, 100)
    texts = {1: [f"x{i}" if i < 12 else w for i, w in enumerate(base)], 2: base, 3: [f"y{i}" if i >= 85 else w for i, w in enumerate(base)]}
    texts |= {10 + k: prose(rng, 100) for k in range(40)}
    rows = frame(spark, [(i, " ".join(w)) for i, w in texts.items()])
    for ids in ([1, 2, 3], list(texts)):
        reps = spark.createDataFrame([(i, 100, [7]) for i in ids], "rep long, n int, keys array<long>")
        links = order_minhash.similar_links(rows, reps).collect()
        assert sorted((r["a"], r["b"]) for r in links) == [(1, 2), (2, 3)]


def test_similar_texts_share_a_sketch():
    """Nearly all pairs at 0.8 to 0.9 meet, by shingles and, in large buckets, by words; also short texts."""
    rng = random.Random(14)
    for n, changed in ((150, 30), (150, 24), (150, 15), (60, 12), (40, 8), (24, 4), (12, 2), (7, 1)):
        shared = Counter()
        for _ in range(150):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            both, _, _, at = order_minhash.word_runs(pa.array([" ".join(words), " ".join(substituted(rng, words, changed))]))
            for keys in (order_minhash.text_keys, order_minhash.word_keys):
                shared[keys.__name__] += bool(set(keys(both[: at[1]])) & set(keys(both[at[1] :])))
        assert min(shared["text_keys"], shared["word_keys"]) >= 145, (n, changed, shared)


def test_codes_leave_no_similar_pair_out(spark):
    """Texts with a common passage in one bucket: only what the codes can't tell apart meets, all similar pairs among it."""
    rng = random.Random(16)
    passage = prose(rng, 60)
    texts = [passage + [f"u{rng.randrange(10**6)}" for _ in range(30)] for _ in range(120)]
    texts += [substituted(rng, w, n) for w, n in zip(texts[:12], (2, 5, 9, 12, 16, 17, 18, 18, 18, 18, 18, 18))]
    # Repeated words, and a class of texts that differ among themselves.
    texts += [["a", "b"] * 20 + prose(rng, 20), ["a", "b"] * 24 + prose(rng, 12), *[substituted(rng, texts[0], 3) for _ in range(5)]]
    words, _, _, at = order_minhash.word_runs(pa.array([" ".join(w) for w in texts]))
    own = [words[i:j] for i, j in zip(at[:-1], at[1:])]
    codes = np.array([order_minhash.word_code(w) for w in own])
    for i in range(len(own)):
        for j in range(i):
            common = sum((Counter(own[i].tolist()) & Counter(own[j].tolist())).values())
            assert np.bitwise_count((codes[i] ^ codes[j]).view(np.uint64)).sum() <= len(own[i]) + len(own[j]) - 2 * common
    finer = [(i, len(w), len(w), [7, 100 + i], c.tolist()) for i, (w, c) in enumerate(zip(own, codes))]
    finer = spark.createDataFrame(finer, "doc long, n int, words int, keys array<long>, code array<long>")
    classes = spark.createDataFrame([(i, 0) for i in range(len(texts) - 5, len(texts))], "node long, root long")
    got = {(r["a"], r["b"]) for r in order_minhash._pairs_across_classes(finer, classes, 0.8).collect()}
    root = lambda i: 0 if i >= len(texts) - 5 else i
    similar = {(j, i) for i in range(len(own)) for j in range(i) if order_minhash.similarity(own[j], own[i]) >= 0.8 and root(i) != root(j)}
    assert len(similar) >= 12 and similar <= got
    # All 8,000 pairs before.
    assert len(got) < 400


# ---- passages ---------------------------------------------------------------------


def plain_chain(x, y):
    score = [0.0] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (x[i], y[i])):
        before = [score[j] - substring_dedup.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(len(x)) if x[j] < x[i] and y[j] < y[i]]
        score[i] = substring_dedup.SEED_WORDS + max([0.0, *before])
    return max(score, default=0.0)


def test_chains_are_the_best(spark):
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 14)
        x, y = ([rng.randrange(60) for _ in range(n)] for _ in range(2))
        found = substring_dedup.chains(x, y)
        assert sorted(i for chain in found for i in chain) == list(range(n))
        best = found[0]
        assert all(x[i] < x[j] and y[i] < y[j] for i, j in zip(best, best[1:]))
        gaps = sum(x[j] - x[i] + y[j] - y[i] for i, j in zip(best, best[1:]))
        score = substring_dedup.SEED_WORDS * len(best) - substring_dedup.GAP_COST * gaps
        assert abs(score - plain_chain(x, y)) < 1e-9


def test_every_long_run_has_a_seed():
    rng = random.Random(5)
    run = prose(rng, substring_dedup.SEED_WORDS + substring_dedup.WINDOW - 1)
    for n in (0, 3, 40):
        texts = [" ".join(prose(rng, n) + run + prose(rng, 30)), " ".join(prose(rng, 25) + run), " ".join(run)]
        words, _, _, at = substring_dedup.word_runs(pa.array(texts))
        doc, _, value, _ = substring_dedup.seeds(words, at)
        assert set.intersection(*[set(value[doc == d].tolist()) for d in range(3)])
    words, _, _, at = substring_dedup.word_runs(pa.array(["", "a b", "a b c d e"]))
    assert substring_dedup.seeds(words, at)[0].tolist() == [2]


def test_seeds_that_are_stuck_cannot_grow(spark):
    rng = random.Random(9)
    rows, truth = [], []
    for _ in range(300):
        seed = prose(rng, 5)
        sides = [prose(rng, rng.choice([3, 12, 12])) for _ in range(2)]
        copies = [[w if rng.random() < share else rng.choice(WORDS) for w in s] for s in sides for share in [rng.choice([0.1, 0.5, 1.0])]]
        texts = [sides[0] + seed + sides[1], copies[0] + seed + copies[1]]
        words, _, _, at = substring_dedup.word_runs(pa.array([" ".join(t) for t in texts]))
        ids = {tuple(words[at[d] + len(sides[0]) : at[d] + len(sides[0]) + 5].tolist()) for d in range(2)}
        assert len(ids) == 1
        around = []
        for d in range(2):
            own = words[at[d] : at[d + 1]]
            code, p = 0, len(sides[0])
            for k in range(substring_dedup.AROUND):
                for shift, i in ((k, p - 1 - k), (substring_dedup.AROUND + k, p + 5 + k)):
                    code |= (int(own[i] % np.uint64(7)) if 0 <= i < len(own) else 7) << (3 * shift)
            around.append(code)
        a, b = (words[at[d] : at[d + 1]] for d in range(2))
        p = len(sides[0])
        grown = max(substring_dedup._grow(a[:p][::-1], b[:p][::-1], 4.0), substring_dedup._grow(a[p + 5 :], b[p + 5 :], 4.0))
        rows.append(around)
        truth.append(grown)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, b long")
    got = [r[1] for r in df.select("i", substring_dedup.stuck(F.col("a"), F.col("b"), 0.8)).orderBy("i").collect()]
    assert 50 < sum(got) < 290
    assert all(grown <= substring_dedup.AROUND for stuck, grown in zip(got, truth) if stuck)


def test_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(6)
    passage = prose(rng, 70)
    fuzzy = [w if i % 17 else "odd" for i, w in enumerate(passage)]
    docs = [
        (1, prose(rng, 200)), (2, prose(rng, 30) + passage + prose(rng, 90)), (3, prose(rng, 120) + fuzzy), (4, passage + prose(rng, 10)),
        (5, prose(rng, 50) + passage[:30] + prose(rng, 40)), (6, prose(rng, 300)), (7, prose(rng, 20) + passage[:35] + ["extra"] * 3 + passage[35:]),
    ]
    texts = [(i, ", ".join(w)) for i, w in docs]
    rows = frame(spark, texts + [(None, " ".join(passage)), (8, None), (9, ""), (10, texts[0][1].upper())])
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(rows).collect()}
    assert set(got) == {3, 4, 7, 10} and {r["source_id"] for r in got.values()} <= {1, 2, 3}
    assert (got[4]["first_word"], got[4]["last_word"], got[4]["source_first"], got[4]["source_last"]) == (0, 70, 30, 100)
    assert texts[3][1][got[4]["start"] : got[4]["end"]] == ", ".join(passage) and got[4]["similarity"] == 1.0
    assert 120 <= got[3]["first_word"] <= 122 and got[3]["last_word"] >= 188 and got[3]["similarity"] > 0.9
    assert got[7]["n_aligned"] == 70 and (got[7]["first_word"], got[7]["last_word"]) == (20, 93)
    assert (got[10]["source_id"], got[10]["n_aligned"]) == (1, 200)
    assert substring_dedup.repeated_passages(rows.limit(0)).count() == 0


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(15)
    passage = prose(rng, 60)
    docs = [
        (1, prose(rng, 40) + passage[:30] + prose(rng, 40)), (2, prose(rng, 20) + passage[30:] + prose(rng, 40)),
        (3, prose(rng, 50) + passage + prose(rng, 30)), (4, prose(rng, 10) + passage + prose(rng, 60)),
    ]
    got = substring_dedup.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()
    assert [(r["doc_id"], r["source_id"], r["first_word"], r["last_word"], r["source_first"]) for r in got] == [(4, 3, 10, 70, 50)]


def test_passages_that_grow_beyond_what_is_cut_for_them(spark, monkeypatch):
    """The texts that meet are cut to their chains; where a passage goes on, the rows are still those of whole texts."""
    rng = random.Random(17)
    passage = prose(rng, 300)
    docs = [
        (1, ["zéro"] * 3 + passage[:200]), (2, prose(rng, 900) + passage + prose(rng, 900)), (3, prose(rng, 30) + passage[:140] + ["odd"] * 5 + passage[140:]),
        (4, prose(rng, 1_200) + ["é"] + passage[150:] + prose(rng, 700)), (5, passage[220:] + prose(rng, 400)),
    ]
    rows = frame(spark, [(i, ", ".join(w)) for i, w in docs])
    moved = []
    cut = substring_dedup._spans
    spans = cut([[(900 << 32) + 3]], False, 2_100, 64)
    assert spans == [(836, 969)] and cut([[3], [900], [40]], True, 920, 64) == [(0, 109), (836, 920)]
    for around in (substring_dedup.SURROUNDINGS, 1, 5_000):
        monkeypatch.setattr(substring_dedup, "SURROUNDINGS", around)
        moved.append(sorted(substring_dedup.repeated_passages(rows).collect()))
    assert moved[0] == moved[1] == moved[2]
    texts = {i: ", ".join(w) for i, w in docs}
    own = {i: texts[i].split(", ") for i in texts}
    assert {(r["doc_id"], r["source_id"]) for r in moved[0]} >= {(2, 1), (3, 1), (3, 2), (4, 2), (5, 2)}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == ", ".join(own[r["doc_id"]][r["first_word"] : r["last_word"]]) for r in moved[0])


def test_many_ends_grow_like_each_alone():
    rng = np.random.default_rng(18)
    a = rng.integers(0, 40, 3_000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 40, 400).astype(np.uint64), a[1_300:]])
    b[rng.choice(len(b), 60, replace=False)] = 99
    # Ends on one diagonal, which grow far, and by chance.
    i = rng.integers(0, len(a), 600)
    j = np.where(np.arange(600) < 300, i, rng.integers(0, len(b), 600))
    step = np.where(rng.random(600) < 0.5, -1, 1)
    room = np.where(step > 0, np.minimum(len(a) - i, len(b) - j), np.minimum(i, j) + 1)
    room = np.where(rng.random(600) < 0.3, rng.integers(0, room + 1), room)
    got, ended = substring_dedup.grown(a, b, i, j, step, room, 4.0)
    for e in range(600):
        here, there = (w[p:] if step[e] > 0 else w[: p + 1][::-1] for w, p in ((a, i[e]), (b, j[e])))
        found = []
        assert got[e] == substring_dedup._grow(here[: room[e]], there[: room[e]], 4.0, found) and ended[e] == found[0], e
    assert got.max() > 512 and 0 < ended.sum() < 600


def test_chance_chains_are_not_aligned_one_by_one(monkeypatch):
    """Two texts share a passage and a hundred short stretches, each elsewhere: only the passage is cut into blocks."""
    rng = random.Random(19)
    word = lambda: f"u{rng.randrange(10**9)}"
    passage, short = [word() for _ in range(60)], [[word() for _ in range(12)] for _ in range(100)]
    texts = []
    for turned in (False, True):
        words = [word() for _ in range(40)] + passage
        for own in short[::-1] if turned else short:
            words += own + [word() for _ in range(30)]
        texts.append(words)
    words, _, _, at = substring_dedup.word_runs(pa.array([" ".join(w) for w in texts]))
    doc, place, value, _ = substring_dedup.seeds(words, at)
    first = {v: p for d, p, v in zip(doc.tolist(), place.tolist(), value.tolist()) if d == 0}
    links = [(p << 32) + first[v] for d, p, v in zip(doc.tolist(), place.tolist(), value.tolist()) if d == 1 and v in first]
    chained = [[links[i] for i in c] for c in substring_dedup.chains([k >> 32 for k in links], [k & 0xFFFFFFFF for k in links])]
    sides = []
    for w in texts[::-1]:
        sides += [pa.array([len(w)], pa.int32()), pa.array([[0]], pa.list_(pa.int32())), pa.array([[0]], pa.list_(pa.int64())), pa.array([[" ".join(w)]])]
    columns = [pa.array([7]), pa.array([3]), pa.array([chained], pa.list_(pa.list_(pa.int64()))), *sides]
    batch = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
    cut, blocks = [], substring_dedup._blocks
    monkeypatch.setattr(substring_dedup, "_blocks", lambda *a: cut.append(a) or blocks(*a))
    [out] = substring_dedup._passage_rows(iter([batch]), 45, 0.8)
    assert len(chained) > 50
    assert [(r["doc_id"], r["source_id"], r["first_word"], r["last_word"], r["source_first"]) for r in out.to_pylist()] == [(7, 3, 40, 100, 40)]
    # One for each chain before.
    assert len(cut) == 1


def test_pairs_of_near_seeds_equal_brute_force():
    rng = random.Random(20)
    docs = [sorted((rng.randrange(300), rng.randrange(12), rng.randrange(3), rng.randrange(200)) for _ in range(n)) for n in (0, 1, 30, 7, 0, 90)]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("seed", pa.int64()), ("source_id", pa.int64()), ("at", pa.int32())]))
    own = pa.array([[dict(zip(("place", "seed", "source_id", "at"), x)) for x in d] for d in docs], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 16)), own], names=["doc_id", "own"])
    got = defaultdict(list)
    for out in substring_dedup._pair_rows(iter([batch.slice(1), batch.slice(0, 1)])):
        for r in out.to_pylist():
            places = [(x["p"], x["q"]) for x in r["places"]]
            assert places == sorted(places) and (r["doc_id"], r["pair"]) not in got
            got[r["doc_id"], r["pair"]] = places
    want = defaultdict(list)
    for d, seeds in enumerate(docs, 10):
        for i, x in enumerate(seeds):
            for y in seeds[i + 1 : i + 1 + substring_dedup.LATER]:
                if x[2] != y[2] or abs(y[3] - x[3] - y[0] + x[0]) > substring_dedup.WINDOW:
                    want[d, x[1], y[1]].append((x[0], y[0]))
    assert sorted((d, sorted(p)) for (d, *_), p in want.items()) == sorted((d, p) for (d, _), p in got.items())
    # One hash for each pair of seeds, in whatever document.
    assert len({k for _, k in got}) == len({k[1:] for k in want})


def test_very_common_seeds_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 10)
    rows = spark.createDataFrame([(5 if i % 4 else i, i, i % 3, -i) for i in range(400)], "seed long, doc_id long, place int, around long")
    counted = Counter(r["seed"] for r in rows.collect())
    seeds = spark.createDataFrame([(s, n, 10 * s) for s, n in counted.items() if s % 8 != 4], "seed long, n long, more long")
    usual = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = substring_dedup._with_seeds(rows, seeds)
        tasks = Counter(r[0] for r in met.where("seed = 5").select(F.spark_partition_id()).collect())
        got, want = sorted(met.collect()), sorted(rows.join(seeds.drop("n"), "seed").collect())
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert met.columns == ["seed", "doc_id", "place", "around", "more"] and got == want
    # All in one before.
    assert sum(tasks.values()) == 300 and max(tasks.values()) < 200


def with_edits(rng, words, share, kinds):
    """Words of which this share is substituted (s), deleted (d) or followed by another (i)."""
    out = []
    for w in words:
        kind = rng.choice(kinds) if rng.random() < share else ""
        out += [] if kind == "d" else [f"new{rng.randrange(10**9)}"] if kind == "s" else [w, f"new{rng.randrange(10**9)}"] if kind == "i" else [w]
    return out


def pair_passages(texts):
    """The passages of the second text in the first, by all its seeds."""
    words, _, _, at = substring_dedup.word_runs(pa.array([" ".join(w) for w in texts]))
    doc, place, value, _ = substring_dedup.seeds(words, at)
    first = {v: p for d, p, v in reversed(list(zip(doc.tolist(), place.tolist(), value.tolist()))) if d == 0}
    links = [(p << 32) + first[v] for d, p, v in zip(doc.tolist(), place.tolist(), value.tolist()) if d == 1 and v in first]
    rows = pa.RecordBatch.from_pydict({"doc_id": [7], "source_id": [3], "links": pa.array([links], pa.list_(pa.int64())), "runs": pa.array([[]], pa.list_(pa.int64()))})
    [chained] = substring_dedup._chain_rows(iter([rows]))
    sides = []
    for w in texts[::-1]:
        sides += [pa.array([len(w)], pa.int32()), pa.array([[0]], pa.list_(pa.int32())), pa.array([[0]], pa.list_(pa.int64())), pa.array([[" ".join(w)]])]
    batch = pa.RecordBatch.from_arrays([*chained.columns, *sides], names=[f"c{i}" for i in range(11)])
    [out] = substring_dedup._passage_rows(iter([batch]), substring_dedup.LEAST_WORDS, substring_dedup.SIMILARITY)
    return out.to_pylist()


def test_passages_with_scattered_edits_are_found():
    """Shares of the passages found, and of their words, against a plain alignment; 0.36 and 0.28 for 60 words at 0.1 before."""
    for n, share, kinds, least in ((60, 0.05, "sid", 0.97), (60, 0.1, "s", 0.95), (60, 0.1, "sid", 0.95), (100, 0.1, "sid", 0.97), (200, 0.15, "sid", 0.95)):
        rng = random.Random(23)
        found = covered = words = 0
        for _ in range(60):
            passage = [f"w{rng.randrange(3000)}" for _ in range(n)]
            copy = with_edits(rng, passage, share, kinds)
            while plain_common([*map(hash, passage)], [*map(hash, copy)], n) < 0.8 * max(n, len(copy)):
                copy = with_edits(rng, passage, share, kinds)
            other = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
            got = pair_passages([other(120) + passage + other(90), other(70) + copy + other(150)])
            own = {i for r in got for i in range(r["first_word"], r["last_word"])}
            inside = own & set(range(70, 70 + len(copy)))
            found, covered, words = found + bool(inside), covered + len(inside), words + len(copy)
            # At most a fifth of a passage is unlike, and it ends with equal words.
            assert len(own - inside) <= 10
        assert found >= least * 60 and covered >= (least - 0.07) * words, (n, share, kinds, found, covered / words)


def test_words_between_diagonals_are_split_where_they_differ():
    rng = random.Random(24)
    left = [f"w{i}" for i in range(60)]
    for _ in range(50):
        right = with_edits(rng, left, 0.2, "sid")
        out = substring_dedup._between(left, right, 100, 200, 4.0)
        assert [o[0] for o in out] == [100, *[o[1] for o in out[:-1]]] and [o[2] for o in out] == [200, *[o[3] for o in out[:-1]]]
        assert (out[-1][1], out[-1][3]) == (160, 200 + len(right))
        same = sum(o[4] for o in out)
        assert same <= plain_common(left, right, 60) <= same + 6
        assert all(left[i - 100 : j - 100] == right[p - 200 : q - 200] for i, j, p, q, n in out if n == max(j - i, q - p))
    assert substring_dedup._between(left, left[:59], 0, 0, 4.0) == [(0, 60, 0, 59, 59)]
    assert substring_dedup._between([], left[:3], 5, 7, 4.0) == [(5, 5, 7, 10, 0)]


def test_windows_are_equal_where_their_words_are():
    rng = random.Random(25)
    run = prose(rng, 70)
    texts = [prose(rng, 9) + run + prose(rng, 30), run, prose(rng, 50) + run[:40], prose(rng, 4), []]
    words, _, _, at = substring_dedup.word_runs(pa.array([" ".join(w) for w in texts]))
    doc = np.repeat(np.arange(5), np.diff(at))
    place = np.arange(len(words)) - at[doc]
    for size in (45, 20, 5, 3):
        codes = substring_dedup.windows(words, at, doc, place, size)
        seen = {}
        for d, p, code in zip(doc.tolist(), place.tolist(), codes.tolist()):
            for k, before in enumerate((0, (size - 5) // 2, size - 5)):
                own = tuple(texts[d][p - before : p - before + size]) if p >= before >= 0 else ()
                assert (code >> 21 * k & (1 << 21) - 1 != 0) == (len(own) == size)
                if len(own) == size:
                    assert seen.setdefault(code >> 21 * k & (1 << 21) - 1, own) == own
        assert len(set(seen.values())) == len(seen)


def test_passages_of_which_earlier_documents_hold_less(spark):
    """All seeds of the passage stand first in a document that holds too little of it; it had no source before."""
    rng = random.Random(83)
    passage = prose(rng, 64)
    docs = [(1, prose(rng, 40) + passage[11:53] + prose(rng, 40)), *[(i, prose(rng, 20 * i) + passage + prose(rng, 50)) for i in (2, 3, 4)]]
    got = sorted(substring_dedup.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect())
    assert [(r["doc_id"], r["source_id"], r["first_word"], r["last_word"], r["source_first"]) for r in got] == [(3, 2, 60, 124, 40), (4, 2, 80, 144, 40)]


def test_an_id_with_several_texts_keeps_the_passages_of_each(spark):
    """What another text of the same id does not hold is left to the text that holds it; before, this failed."""
    rng = random.Random(21)
    passage = prose(rng, 80)
    texts = [(1, prose(rng, 500) + passage), (1, []), (2, prose(rng, 450) + passage), (2, ["a"])]
    got = substring_dedup.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in texts])).collect()
    assert [(r["doc_id"], r["source_id"], r["first_word"], r["last_word"], r["source_first"]) for r in got] == [(2, 1, 450, 530, 500)]


def test_words_are_hashed_as_runs_of_bytes():
    rng = random.Random(22)
    for n in (0, 1, 30):
        texts = pa.array(["".join(rng.choices("aBé1. \n漢-", k=rng.randrange(40))) for _ in range(n)], pa.string())
        hashes, starts, ends, at = substring_dedup.word_runs(texts)
        data = np.frombuffer("".join(texts.to_pylist()).encode().lower(), np.uint8)
        assert (hashes == arrays.hash_runs(data, starts, ends)).all() and len(hashes) == len(starts) == at[-1]
        assert all((x == y).all() for x, y in zip(arrays.word_bounds(texts), (starts, ends, at)))


# ---- suffix dedup -----------------------------------------------------------------


def plain_removal(texts):
    size = suffix_dedup.LENGTH
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared, other = text(420), text(260)
    texts = [
        text(900), shared, text(80) + shared + text(50), text(30) + shared[:199], shared[100:350] + text(70) + shared[:230], text(10) + other + text(5) + other,
        "z" * 500, "ab" * 180, "", None, text(199), text(2_000) + shared + text(300), "y" * 200, text(60) + "y" * 199, shared[:-1] + "!", text(300), text(300),
    ]
    texts += [texts[0], texts[15][:150] + texts[16][:150]]
    return texts + [text(40) + other[i : i + 205] for i in range(0, 50, 7)]


def test_suffix_dedup_equals_brute_force(spark):
    texts = repeating_texts()
    ids = [None if i in (2, 5) else i for i in range(len(texts))] + [0, 0]
    texts += [texts[0], texts[16]]
    got = suffix_dedup.remove_repeats(frame(spark, list(zip(ids, texts)))).collect()
    key = lambda r: (repr(r[0]), r[4], r[1:4])
    want = sorted(((i, *r) for i, r in zip(ids, plain_removal(texts))), key=key)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=key) == want
    assert suffix_dedup.remove_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_pieces_with_very_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    texts = repeating_texts()
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, list(enumerate(texts)))).collect()}
    for i, want in enumerate(plain_removal(texts)):
        assert tuple(got[i])[1:] == want, i


def test_very_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 300)
    batch = pa.RecordBatch.from_arrays([pa.array(repeating_texts()).fill_null("")], names=["text"])
    windows = defaultdict(int)
    for data, offsets, rows, base in suffix_dedup._segments(batch, 0):
        doc, start, size, anchor, _ = suffix_dedup.anchors(data, offsets)
        for d, s, n, a in zip(doc, start, size, anchor):
            assert s <= a + 0 and a <= s + suffix_dedup.LENGTH - suffix_dedup.PIECE
            for k in range(n):
                windows[int(rows[d]), int(s + base[d] + k)] += 1
    sizes = [len((t or "").encode()) for t in repeating_texts()]
    assert windows == {(i, k): 1 for i, n in enumerate(sizes) for k in range(n - suffix_dedup.LENGTH + 1)}


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 2, 3_000).astype(np.uint8)
    data[1_000:1_400] = data[200:600]
    start = rng.choice(len(data) - suffix_dedup.LENGTH, 900, replace=False)
    group = rng.integers(0, 5, 900)
    suffixes = suffix_dedup.Suffixes(data)
    order = suffixes.sort(start, group)
    text = data.tobytes()
    keys = [(group[i], text[start[i] : start[i] + suffix_dedup.LENGTH]) for i in order]
    assert sorted(order) == list(range(900)) and keys == sorted(keys)
    equal = suffixes.equal_neighbours(order, start, group)
    assert equal.tolist() == [a == b for a, b in zip(keys, keys[1:])] and equal.any()
