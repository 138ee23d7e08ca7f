"""Near-dedup by order MinHash.

A document's shingles are its runs of three words, labelled with their occurrence number so that repeats count. Each of
``BANDS`` sketches takes the ``TAKE`` shingles with the smallest hashes and keeps them in text order, so two documents
share a sketch if they share those shingles in that order; short texts have ``SHORT_BANDS`` of single shingles besides.
Documents with a common sketch are candidates; a banded alignment of their words verifies them: the aligned share of the
longer text has to reach the similarity.

Texts with the same words are one class from the start. Within a bucket all candidates are compared with the smallest
id. Those that are not similar to it, the rest, are compared with all other members, also with those that are similar to
it: a link may lead from there to the rest. Where that is too many pairs (a passage that very many share), all members
go on in buckets of longer sketches over single words, which similar texts share and texts with no more than a passage
in common hardly ever; there all members meet their leader, then those that no link has brought into one class so far
meet each other, however many. Before they do, codes of their words (a bit for each of ``CODE`` hashes that an odd number
of words falls on) tell how many words two texts differ in at least, first for whole classes, then for a text and a class,
last for two texts. What differs too much by these can't be similar and makes no pair. Classes are the connected
components of the links.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, text_bytes, word_runs
from leadloom.llm.common import keep, whole_text
from leadloom.llm.components import connected_components

SHINGLE, SIMILARITY = 3, 0.8
BANDS, TAKE = 64, 2
#: Texts of fewer words are alike only if equal.
LEAST_WORDS = 6
#: Sketches of one shingle, for texts of up to SHORT words and those that may be similar to them.
SHORT, SHORT_BANDS = 20, 32
#: Sketches over single words, for the documents of large buckets; short texts take fewer words.
WORD_BANDS, WORD_TAKE, SHORT_TAKE = 128, 7, 5
#: A bucket's rest meets its members up to the square of this many pairs; beyond that by way of words.
SMALL = 24
#: Bits of the code of a text's words.
CODE = 2048
#: Bytes of text that are cut into words at once (a longer text alone); numpy takes some fifty times as much.
_BYTES = 1 << 20
_rng = np.random.default_rng(5)
_ALL = BANDS + SHORT_BANDS + WORD_BANDS
_MIX = _rng.integers(1, 1 << 63, _ALL, np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 63, _ALL, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each run of three words; a shorter text is one shingle."""
    if not len(words):
        return words
    n = max(len(words) - SHINGLE + 1, 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        total = total * _STEP + (words[i : i + n] ^ (words[i : i + n] >> np.uint64(29)))
    return total ^ (total >> np.uint64(31))


def labelled(values: np.ndarray) -> np.ndarray:
    """Occurrence number (from 0) of each value."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    out = np.zeros(len(values), np.uint64)
    if not new.all():
        at = np.arange(len(values))
        out[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return out


def sketches(values: np.ndarray, bands: range = range(BANDS), take: int = TAKE) -> np.ndarray:
    """A hash per band, of the ``take`` smallest labelled values in text order."""
    own = (values + labelled(values) * _STEP) * _STEP
    take = min(take, len(own))
    step = max(1, min(len(bands), 500_000 // len(own)))
    out = []
    for first in range(bands.start, bands.stop, step):
        band = slice(first, min(first + step, bands.stop))
        order = (own[None] ^ _SEEDS[band, None]) * _MIX[band, None]
        order ^= order >> np.uint64(32)
        place = np.argpartition(order, take - 1, axis=1)[:, :take] if take < len(own) else np.tile(np.arange(take), (len(order), 1))
        place = np.sort(place, axis=1)
        key = _SEEDS[band].copy()
        for i in range(take):
            key = (key ^ own[place[:, i]]) * _STEP
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out).astype(np.int64)


def text_keys(words: np.ndarray) -> np.ndarray:
    """The sketches by which a text's candidates are found."""
    if len(words) < LEAST_WORDS:
        return np.zeros(0, np.int64)
    values = shingles(words)
    keys = sketches(values)
    if len(words) * SIMILARITY <= SHORT:
        keys = np.concatenate([keys, sketches(values, range(BANDS, BANDS + SHORT_BANDS), 1)])
    return keys


def word_keys(words: np.ndarray) -> np.ndarray:
    """The sketches over single words; texts around ``SHORT`` words have both kinds, so that similar ones share a kind."""
    bands = range(BANDS + SHORT_BANDS, _ALL)
    keys = [sketches(words, bands, WORD_TAKE)] if len(words) > SHORT else []
    if len(words) * SIMILARITY <= SHORT:
        keys.append(sketches(words, bands, SHORT_TAKE))
    return np.concatenate(keys)


def word_code(words: np.ndarray) -> np.ndarray:
    """``CODE`` bits: whether an odd number of the labelled words falls on each.

    A word that one of two texts has more turns one bit, so their codes differ in no more bits than they in words.
    """
    own = (words + labelled(words) * _STEP) * _STEP
    own ^= own >> np.uint64(32)
    place = ((own * _STEP) >> np.uint64(40)) % np.uint64(CODE)
    odd = np.bincount(place.astype(np.int64), minlength=CODE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def aligned(a: Sequence[int], b: Sequence[int], width: int) -> int:
    """Length of the longest common subsequence whose partners are at most ``width`` places apart.

    Bit-parallel over the band: a cleared bit of ``row`` is a column where the length grows. Columns that leave the band
    are counted and dropped.
    """
    at: dict[int, int] = defaultdict(int)
    for j, value in enumerate(a):
        at[value] |= 1 << j
    low, high, row, total = 0, 0, 0, 0
    for i, value in enumerate(b):
        if low < i - width:
            if low < high:
                total += not row & 1
                row >>= 1
            low += 1
        reach = min(len(a), i + width + 1)
        if reach > high:
            begin = max(high, low)
            row |= ((1 << (reach - begin)) - 1) << (begin - low) if reach > begin else 0
            high = reach
        both = row & (at.get(value, 0) >> low)
        if both:
            row = ((row + both) | (row - both)) & ((1 << (high - low)) - 1)
    return total + max(high - low, 0) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned words over the words of the longer text; 0 where that can't reach ``least``."""
    n, longer = len(a) + len(b), max(len(a), len(b))
    if not len(a) or not len(b) or min(len(a), len(b)) < least * longer:
        return 0.0
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    needed = least * longer
    known, count = np.unique(a, return_counts=True)
    other, count_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(known, other, assume_unique=True, return_indices=True)
    if head + tail + np.minimum(count[i], count_b[j]).sum() < needed - 1e-9:
        return 0.0
    matched = head + tail + aligned(a.tolist(), b.tolist(), int(n - 2 * needed) + 1)
    return matched / longer


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, 1, _BYTES):
            words, _, _, at = word_runs(batch.column(1))
            digests, sizes, keys = [], [], []
            offsets, data = text_bytes(batch.column(1))
            for i in range(batch.num_rows):
                own = words[at[i] : at[i + 1]]
                content = own.tobytes() if len(own) else b"text:" + data[offsets[i] : offsets[i + 1]].tobytes()
                digests.append(hashlib.blake2b(content, digest_size=16).digest())
                sizes.append(len(own))
                keys.append(text_keys(own))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "keys"])


def _word_sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word sketches, the code and the number of words of rows (doc, n, text)."""
    for whole in batches:
        for batch in by_size(whole, 2, _BYTES):
            words, _, _, at = word_runs(batch.column(2))
            own = [words[i:j] for i, j in zip(at[:-1], at[1:])]
            lists = [pa.array([f(w) for w in own], pa.list_(pa.int64())) for f in (word_keys, word_code)]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "words", "keys", "code"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (part for half in by_size(whole, 2, _BYTES) for part in by_size(half, 3, _BYTES)):
            sides = []
            for column in (2, 3):
                words, _, _, at = word_runs(batch.column(column))
                sides.append([words[i:j] for i, j in zip(at[:-1], at[1:])])
            similar = [similarity(a, b, least) >= least - 1e-12 for a, b in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.bool_())], names=["a", "b", "similar"])


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b, similar`` for pairs (a < b)."""
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return keep(met.mapInArrow(lambda batches: _verified(batches, least), "a bigint, b bigint, similar boolean"), "verified")


def _meet_leaders(bands: DataFrame, tested: DataFrame | None, texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs tested so far and now, each bucket's members but its leader with whether they are similar to it, and the
    sizes (``r``, ``m``) of rests and members of the buckets where a rest has someone to meet."""
    leaders = bands.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    leaders = keep(leaders.select("key", F.col("lead.doc").alias("a"), F.col("lead.n").alias("lead_n")), "leaders")
    members = bands.join(leaders, "key").where("doc <> a")
    close = F.least("n", "lead_n") >= least * F.greatest("n", "lead_n")
    members = keep(members.select("key", "doc", "n", "a", close.alias("close")), "members")
    pairs = members.where("close").select("a", F.col("doc").alias("b")).distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    told = _verify(pairs, texts, least)
    tested = told if tested is None else tested.unionByName(told)
    met = members.join(tested.select("a", F.col("b").alias("doc"), "similar"), ["a", "doc"], "left")
    met = keep(met.select("key", "doc", "n", (~F.coalesce("similar", F.lit(False))).alias("rest")), "met")
    sizes = met.groupBy("key").agg(F.count_if("rest").alias("r"), F.count("*").alias("m")).where("r > 0 and m > 1")
    return tested, met, keep(sizes, "rest-sizes")


def _rest_pairs(met: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """``a, b`` (a < b): each rest member of these buckets with each other member that its length allows."""
    sized = met.join(sizes.select("key"), "key")
    rest = sized.where("rest").select("key", F.col("doc").alias("c"), F.col("n").alias("n_c"))
    near = F.least("n", "n_c") >= least * F.greatest("n", "n_c")
    # Two of the rest meet once.
    once = (F.col("doc") > F.col("c")) | ~F.col("rest")
    pairs = rest.join(sized, "key").where(near & once)
    return pairs.select(F.least("c", "doc").alias("a"), F.greatest("c", "doc").alias("b")).distinct()


def _may_be_similar(x: Column, y: Column, least: float) -> Column:
    """Whether the codes let any two texts of these be similar: structs of ``low`` and ``high`` (least and most words of a
    text) and the bits ``every`` and ``some`` text has."""

    def only(one: Column, other: Column) -> Column:
        bits = F.zip_with(one, other, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(bits, F.lit(0), lambda total, n: total + n)

    # Similar texts differ in at most n + m - 2 * least * max(n, m) words, that is min(n, m) + (1 - 2 * least) * max(n, m).
    longer = F.greatest(x["low"], y["low"]) if least >= 0.5 else F.greatest(x["high"], y["high"])
    room = F.least(x["high"], y["high"]) + (1 - 2 * least) * longer + 1e-6
    return only(x["every"], y["some"]) + only(y["every"], x["some"]) <= room


def _pairs_across_classes(finer: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``a, b`` (a < b): the pairs of members with a common key that aren't in one class (node, root) yet, where lengths
    and codes allow.

    A link within a class joins nothing new, so a bucket of one class makes no pair, however large it is. In the others
    the classes meet first, as slim rows, then the texts of the smaller class meet the other class, last its texts.
    """
    held = finer.join(classes, F.col("doc") == F.col("node"), "left").withColumn("class", F.coalesce("root", "doc"))
    held = keep(held.select("class", "doc", "n", "words", "keys", "code").distinct(), "class-members")
    present = held.select("class", "n", F.explode("keys").alias("key"))
    present = present.groupBy("key", "class").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    several = present.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1").select("key")
    present = keep(present.join(several, "key"), "bucket-classes")
    one, other = (present.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "low", "high")]) for x in "xy")
    # The longest of the one has to reach the shortest of the other, both ways.
    reach = (F.col("high_x") >= least * F.col("low_y")) & (F.col("high_y") >= least * F.col("low_x"))
    meeting = one.join(other, "key").where((F.col("class_x") < F.col("class_y")) & reach).select("class_x", "class_y").distinct()
    bits = [F.array(*[f(F.col("code")[i]) for i in range(CODE // 64)]) for f in (F.bit_and, F.bit_or)]
    told = held.groupBy("class").agg(
        F.struct(F.min("words").alias("low"), F.max("words").alias("high"), bits[0].alias("every"), bits[1].alias("some"), F.count("*").alias("size")).alias("told")
    )
    told = keep(told, "class-codes")
    x, y = (told.select(F.col("class").alias(f"class_{c}"), F.col("told").alias(c)) for c in "xy")
    meeting = meeting.join(x, "class_x").join(y, "class_y").where(_may_be_similar(F.col("x"), F.col("y"), least))
    x_first = F.col("x.size") <= F.col("y.size")
    meeting = meeting.select(
        F.when(x_first, F.col("class_x")).otherwise(F.col("class_y")).alias("class_c"),
        F.when(x_first, F.col("class_y")).otherwise(F.col("class_x")).alias("class_d"),
        F.when(x_first, F.col("y")).otherwise(F.col("x")).alias("told"),
    )
    meeting = keep(meeting, "class-pairs")
    code = F.struct(F.col("words").alias("low"), F.col("words").alias("high"), F.col("code").alias("every"), F.col("code").alias("some"))
    c, d = (
        held.select(F.col("class").alias(f"class_{x}"), F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}"), code.alias(f"code_{x}"))
        for x in "cd"
    )
    texts = meeting.join(c, "class_c").where(_may_be_similar(F.col("code_c"), F.col("told"), least)).drop("told", "class_c")
    near = F.least("n_c", "n_d") >= least * F.greatest("n_c", "n_d")
    both = texts.join(d, "class_d").where(near & _may_be_similar(F.col("code_c"), F.col("code_d"), least) & F.arrays_overlap("keys_c", "keys_d"))
    return both.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def similar_links(documents: DataFrame, reps: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``a, b``: links that join all similar candidates among ``reps`` (rep, n, keys), directly or by way of others.

    Candidates share a key; those that share only keys of large buckets have to share a sketch over words, too.
    """
    texts = documents.select("doc_id", whole_text().alias("text"))
    bands = reps.where(F.size("keys") > 0).select(F.col("rep").alias("doc"), "n", F.explode("keys").alias("key"))
    tested, met, sizes = _meet_leaders(bands, None, texts, least)
    is_small = F.col("r") * F.col("m") <= SMALL * SMALL
    pairs = _rest_pairs(met, sizes.where(is_small), least)
    tested = tested.unionByName(_verify(pairs.join(tested, ["a", "b"], "left_anti"), texts, least))
    large = keep(met.join(sizes.where(~is_small).select("key"), "key").select("doc", "n").distinct(), "large-buckets")
    rows = large.join(texts, F.col("doc") == F.col("doc_id")).select("doc", "n", "text")
    finer = keep(rows.mapInArrow(_word_sketch_rows, "doc bigint, n int, words int, keys array<bigint>, code array<bigint>"), "finer")
    tested, _, _ = _meet_leaders(finer.select("doc", "n", F.explode("keys").alias("key")), tested, texts, least)
    classes = connected_components(tested.where("similar").select("a", "b"))
    pairs = _pairs_across_classes(finer, classes, least)
    tested = tested.unionByName(_verify(pairs.join(tested, ["a", "b"], "left_anti"), texts, least))
    return tested.where("similar").select("a", "b")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept.

    Documents with the same words are one class, also where case, marks and white space differ; texts without words are
    alike only if equal. A null text is empty. Ids are taken to name one text each: rows that repeat an id repeat its
    result. A null id takes part with its text alone: its class is that of its words, null if it has none, and it is
    kept only then. Empty input gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    told = keep(slim.mapInArrow(_sketch_rows, "doc_id bigint, digest binary, n int, keys array<bigint>"), "sketches")
    groups = told.where("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "keys")).alias("r"))
    reps = keep(groups.select("digest", F.col("r.doc_id").alias("rep"), "r.n", "r.keys"), "representatives")
    roots = connected_components(similar_links(slim, reps, least))
    classes = reps.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    classes = keep(classes.select("digest", F.coalesce("root", "rep").alias("class_id")), "classes")
    members = keep(told.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", "class_id"), "members")
    sizes = keep(members.groupBy("class_id").agg(F.count("*").alias("class_size")), "class-sizes")
    return members.join(sizes, members["class_id"].eqNullSafe(sizes["class_id"])).select(
        "doc_id", members["class_id"], "class_size", F.col("doc_id").eqNullSafe(members["class_id"]).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows whose document is its class's smallest id, all columns; of rows that repeat an id all stay."""
    dropped = near_duplicates(docs, least).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(keep(dropped, "dropped"), F.col("doc_id") == F.col("__dropped"), "left_anti")
