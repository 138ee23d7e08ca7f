"""Language identification: script ranges narrow the candidates, Viterbi labels spans of words.

Learned per language: which scripts its letters come from, and how often each feature occurs (character pairs and
triples with word borders, whole words; hashed into ``BUCKETS`` numbers). The counts are aggregated on the cluster; the
driver gets at most ``BUCKETS`` numbers a language. A word's score for a language is the logarithm of how much likelier its
features are there than on average; languages that don't use the word's script aren't candidates. Viterbi with one
penalty for every switch finds the best label of each word; words without letters belong to no span.

Training reads about ``SAMPLE_DOCS`` documents of each language, picked by a hash of the id against a rate per language (all,
where there are fewer); prediction reads every whole text. No shuffle moves a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, text_bytes
from leadloom.llm.common import whole_text

SAMPLE_DOCS = 8_000
BUCKETS = 1 << 15
#: What a change of language between two words costs, in units of the scores (natural logarithms).
SWITCH = 8.0
#: Added to every feature's count.
SMOOTHING = 0.5
#: A script is one of a language's own from this share of its letters on.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
_BYTES = 1 << 20

# ---- fixed values: first and last code points of scripts (Unicode blocks), by name ----
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x0250, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F),
    ("arabic", 0x0750, 0x077F), ("thaana", 0x0780, 0x07BF), ("arabic", 0x08A0, 0x08FF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F),
    ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("georgian", 0x1C90, 0x1CBF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("latin", 0x2C60, 0x2C7F), ("georgian", 0x2D00, 0x2D2F),
    ("cyrillic", 0x2DE0, 0x2DFF), ("kana", 0x3040, 0x30FF), ("bopomofo", 0x3100, 0x312F), ("hangul", 0x3130, 0x318F),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("cyrillic", 0xA640, 0xA69F), ("latin", 0xA720, 0xA7FF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("latin", 0xFB00, 0xFB06), ("hebrew", 0xFB1D, 0xFB4F),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F),
    ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))

_tables: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all code points, once per worker: letter?, part of a word (letter or mark)?, lower case form, script number."""
    global _tables
    if _tables is None:
        kind = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        letter = np.array([k == "L" for k in kind])
        inner = letter | np.array([k == "M" for k in kind])
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(letter).tolist():
            low = chr(i).lower()
            if len(low) == 1:
                lower[i] = ord(low)
        script = np.zeros(0x110000, np.uint8)
        for name, first, last in SCRIPTS:
            script[first : last + 1] = SCRIPT_NAMES.index(name)
        _tables = letter, inner, lower, script
    return _tables


@dataclass
class Words:
    """The words of a slice's texts: runs of letters (and marks) of one script.

    ``at``: first code point of each word among all texts joined by line feeds; ``size``; ``letters`` in it; ``script``;
    ``bounds``: where each text's words begin, and the end; ``begins``: each text's first code point; ``chars``: code
    points of each text; ``points``: lower-case code points, 0 outside words.
    """

    at: np.ndarray
    size: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    bounds: np.ndarray
    begins: np.ndarray
    points: np.ndarray


def split_words(texts: pa.Array) -> Words:
    letter, inner, lower, script = _code_points()
    listed = texts.to_pylist()
    points = np.frombuffer("\n".join([*listed, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in listed], np.int64)
    begins = np.cumsum(sizes) - sizes
    is_letter, is_inner = letter[points], inner[points]
    # A mark belongs to the letter before it, whatever its own script is.
    kind = np.where(is_letter, script[points], 0).astype(np.int16) + 1
    change = np.zeros(len(points), bool)
    if len(points):
        change[0] = is_inner[0]
        both = is_letter[1:] & is_letter[:-1]
        change[1:] = (is_inner[1:] != is_inner[:-1]) | (both & (kind[1:] != kind[:-1]))
    cut = np.append(np.flatnonzero(change), len(points))
    starts, ends = cut[:-1], cut[1:]
    held = is_inner[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    n_letters = np.concatenate([[0], np.cumsum(is_letter, dtype=np.int64)])
    letters = n_letters[ends] - n_letters[starts]
    some = letters > 0
    starts, ends, letters = starts[some], ends[some], letters[some]
    lead = np.flatnonzero(is_letter)
    first = lead[np.searchsorted(lead, starts)] if len(starts) else starts
    low = np.where(is_inner, lower[points], 0).astype(np.uint64)
    bounds = np.append(np.searchsorted(starts, begins), len(starts))
    return Words(starts, ends - starts, letters, script[points[first]], bounds, begins, low)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every feature: pairs and triples with borders, and the whole word. Ordered by word."""
    n = len(words.at)
    first = np.cumsum(words.size) - words.size
    word = np.repeat(np.arange(n), words.size)
    place = np.arange(len(word)) - np.repeat(first, words.size)
    at = place + np.repeat(words.at, words.size)
    a = words.points[at]
    # Borders are zeros, also where two scripts meet without a gap.
    before = np.where(place > 0, words.points[at - 1], 0) if len(at) else a
    after = np.where(place < np.repeat(words.size, words.size) - 1, words.points[np.minimum(at + 1, len(words.points) - 1)], 0) if len(at) else a
    m1, m2, m3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    pair = (before * m1 + a * m2) ^ np.uint64(0x5851F42D)
    triple = before * m1 + a * m2 + after * m3 + np.uint64(1)
    whole = np.add.reduceat((a + np.uint64(1)) * (m3 ** (place.astype(np.uint64) + np.uint64(1))), first) if n else a
    mixed = [_bucket(x) for x in (pair, triple, whole)]
    buckets = np.concatenate(mixed)
    of = np.concatenate([word, word, np.arange(n)])
    order = np.argsort(of, kind="stable")
    return buckets[order], of[order]


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


@dataclass
class Model:
    """``weights[bucket, language]``; ``uses[language, script]``: is the script one of the language's own?"""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Per word and language; minus infinity for languages that aren't candidates, unless none is one: then all zero."""
        buckets, of = features(words)
        total = np.zeros((len(words.at), len(self.languages)))
        if len(of):
            firsts = np.searchsorted(of, np.arange(len(words.at)))
            total = np.add.reduceat(self.weights[buckets], firsts, axis=0, dtype=np.float64)
        candidate = self.uses[:, words.script].T
        total[~candidate] = -np.inf
        total[~candidate.any(1)] = 0.0
        return total


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row; rows ``bounds[i]`` to ``bounds[i + 1]`` are a chain, a change of label costs ``switch``.

    Chains go on side by side, longest first, so a step is one operation on all chains that reach it. Of equal labels
    the smaller one wins, and staying wins over a change.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    first, sizes = first[sizes > 0], sizes[sizes > 0]
    if not len(first):
        return labels
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    stay, jump = np.zeros((n, k), bool), np.zeros(n, np.int64)
    value = scores[first].astype(np.float64)
    ends = np.zeros(len(first), np.int64)
    for t in range(1, int(sizes[0]) + 1):
        go = int(alive[t]) if t < len(alive) else 0
        ends[go : len(value)] = value[go:].argmax(1)
        if not go:
            break
        value = value[:go]
        best = value.argmax(1)
        top = value[np.arange(go), best] - switch
        # Each row has a finite score, so the top is finite and every label can be entered by a change.
        kept = value >= top[:, None]
        at = first[:go] + t
        stay[at], jump[at] = kept, best
        value = np.where(kept, value, top[:, None]) + scores[at]
    last = first + sizes - 1
    labels[last] = ends
    now = ends
    for t in range(int(sizes[0]) - 1, 0, -1):
        # Chains longer than t have a step from t - 1 to t; those that end there begin to go back.
        go = int(alive[t])
        at = first[:go] + t
        now = labels[at]
        labels[at - 1] = np.where(stay[at, now], now, jump[at])
    return labels


def train(counts: np.ndarray, scripts: np.ndarray, languages: list[str]) -> Model:
    """From feature counts ``[bucket, language]`` and letters ``[language, script]``."""
    smoothed = counts + SMOOTHING
    log_p = np.log(smoothed) - np.log(smoothed.sum(0))
    log_mean = np.log(np.exp(log_p).mean(1)) if len(languages) else np.zeros(len(counts))
    letters = scripts.sum(1, keepdims=True)
    uses = scripts >= np.maximum(letters * SCRIPT_SHARE, 1)
    return Model(languages, (log_p - log_mean[:, None]).astype(np.float32), uses)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that training leaves out. A null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, feature, n`` per task: buckets as they are, letters of script ``s`` as feature ``-1 - s``."""
    held: dict[str, np.ndarray] = {}
    width = BUCKETS + len(SCRIPT_NAMES)
    for whole in batches:
        for batch in by_size(whole, 1, _BYTES):
            names = batch.column(0).to_pylist()
            words = split_words(batch.column(1))
            buckets, of = features(words)
            text = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))
            listed = {name: i for i, name in enumerate(dict.fromkeys(names))}
            lang = np.array([listed[name] for name in names])[text] if len(text) else text
            # Languages one after another: a task holds one row of counts a language.
            for name, i in listed.items():
                own = lang == i
                row = held.setdefault(name, np.zeros(width, np.int64))
                row[:BUCKETS] += np.bincount(buckets[own[of]], minlength=BUCKETS)
                row[BUCKETS:] += np.bincount(words.script[own], words.letters[own], len(SCRIPT_NAMES)).astype(np.int64)
    for name, row in held.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * max(len(at), 1)), pa.array(np.where(at < BUCKETS, at, BUCKETS - 1 - at) if len(at) else [0], pa.int64()),
             pa.array(row[at] if len(at) else [0], pa.int64())],
            names=["lang", "feature", "n"],
        )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with a language that aren't held out. Without such rows it knows no language."""
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), whole_text(text_col).alias("text")
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).select(
        F.col("lang").alias("__lang"), (F.lit(float(SAMPLE_DOCS)) / F.col("n")).alias("rate")
    )
    # One row a language: a hash of the id below the rate picks about SAMPLE_DOCS rows of each.
    share = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(sizes), F.col("lang") == F.col("__lang")).where(share < F.col("rate"))
    counted = picked.select("lang", "text").mapInArrow(_count_features, "lang string, feature bigint, n bigint")
    # At most BUCKETS features and the scripts for each language.
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[name] for name in names], np.int64)
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    counts, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(languages), len(SCRIPT_NAMES)))
    plain = feature >= 0
    counts[feature[plain], lang[plain]] = n[plain]
    scripts[lang[~plain], -1 - feature[~plain]] = n[~plain]
    return train(counts, scripts, languages)


def label_slice(batch: pa.RecordBatch, model: Model, switch: float) -> pa.RecordBatch:
    """One slice (id, text) to rows (id, lang_pred, score, spans)."""
    words = split_words(batch.column(1))
    n, k = batch.num_rows, len(model.languages)
    sizes = np.diff(words.bounds)
    text = np.repeat(np.arange(n), sizes)
    if not k or not len(text):
        none = pa.array([[]] * n, _SPANS)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), none], names=_NAMES)
    labels = viterbi(model.scores(words), words.bounds, switch)
    known = model.uses[:, words.script].any(0)
    own = np.bincount(text * k + labels, np.where(known, words.letters, 0), n * k).reshape(n, k)
    # A text whose scripts no language uses goes by its labels alone, with score 0.
    blind = np.bincount(text * k + labels, words.letters, n * k).reshape(n, k)
    letters = blind.sum(1)
    best = np.where(own.any(1), own.argmax(1), blind.argmax(1))
    score = np.where(letters > 0, own[np.arange(n), best] / np.maximum(letters, 1), 0.0)
    predicted = np.where(letters > 0, np.array(model.languages, object)[best], UNKNOWN)
    # Neighbouring words with one label, in scripts that some language uses, are one span.
    at = np.flatnonzero(known)
    new = np.ones(len(at), bool)
    new[1:] = (labels[at[1:]] != labels[at[:-1]]) | (text[at[1:]] != text[at[:-1]]) | (np.diff(at) > 1)
    begin = at[new]
    stop = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    spans = pa.StructArray.from_arrays(
        [pa.array(words.at[begin] - words.begins[text[begin]]), pa.array(words.at[stop] + words.size[stop] - words.begins[text[begin]]),
         pa.array([model.languages[i] for i in labels[begin].tolist()], pa.string())],
        names=["start", "stop", "lang"],
    )
    rows = np.searchsorted(text[begin], np.arange(n + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(predicted.tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.ListArray.from_arrays(pa.array(rows), spans)],
        names=_NAMES,
    )


_NAMES = ["id", "lang_pred", "score", "spans"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))


def label_languages(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, switch: float = SWITCH
) -> DataFrame:
    """One row per row: id, ``lang_pred``, ``score``, ``spans`` (start, stop in code points, lang).

    ``lang_pred`` is the label of most letters (of equal ones the smallest), ``score`` its share of all letters. A null or
    empty text and one without a letter give ``und``, 0 and no spans, as do all texts where no language was learned; letters of
    scripts that no learned language uses lie in no span. Null ids stay; rows that repeat give equal rows; an empty table
    gives none; other columns are ignored. One pass without a shuffle; a task holds one slice of about 1 MB, or one longer
    text, with a row of scores a word, and the model of ``BUCKETS`` numbers a language.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, 1, _BYTES):
                yield label_slice(batch, model, switch)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = f"id {id_type}, lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>"
    return rows.mapInArrow(label, kind).withColumnRenamed("id", id_col)


def predicted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``label_languages`` with a model of the same rows, and ``held_out``."""
    return label_languages(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col).withColumn("held_out", held_out(id_col))
