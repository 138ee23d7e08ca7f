"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the presence of words and of their first bytes (inflected words share a stem) are trained with
numpy on confirmed toxic documents (P) and unlabelled ones (U). The risk is
``prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])``: what the unlabelled documents seem to lose as
negatives is corrected by the share of positives among them, and never counts below zero. Each of a few classifiers
learns on a bootstrap of its own; a line fitted on labelled training rows turns their mean into a probability.

Training reads bounded samples (``POSITIVES``, ``UNLABELLED``, ``CALIBRATION`` documents, the first in the order of a
hash of the id); scoring reads every whole text in Arrow batches, with numpy over the bytes of a batch and at most
``VOCABULARY`` weights in each task. No shuffle moves a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, hash_runs, text_bytes
from leadloom.llm.common import keep, whole_text

POSITIVES, UNLABELLED, CALIBRATION = 4_000, 8_000, 8_000
VOCABULARY = 2_000
#: A word must occur in this many positive documents of the sample, or a twentieth of them if that is less.
LEAST_DOCS = 5
PRIOR = 0.1
MODELS = 3
STEPS = 200
THRESHOLD = 0.7
#: Lengths of the stems that are features beside the words.
STEMS = (4, 5, 6)
_BYTES = 2 << 20

_LETTERS = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])
_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features and each one's text, in the order of the texts.

    A feature is a word (a run of ASCII letters, in lower case, and of other alphabets' characters) or the first bytes of
    a longer one.
    """
    offsets, data = text_bytes(texts)
    letter = _LETTERS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= letter[1:] != letter[:-1]
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    words = letter[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[words], ends[words]
    low, doc = _LOWER[data], np.searchsorted(offsets, starts, "right") - 1
    hashes, docs = [hash_runs(low, starts, ends)], [doc]
    for size in STEMS:
        long = ends - starts > size
        hashes.append(hash_runs(low, starts[long], starts[long] + size) + np.uint64(size))
        docs.append(doc[long])
    order = np.argsort(np.concatenate(docs), kind="stable")
    return np.concatenate(hashes)[order], np.concatenate(docs)[order]


@dataclass
class Model:
    """``words``: sorted hashes; a document's score is the logistic of ``bias`` plus the ``weights`` of the words in it."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        hashes, doc = word_hashes(texts)
        margin = np.full(len(texts), self.bias)
        if len(self.words) and len(hashes):
            place = np.searchsorted(self.words, hashes)
            place[place == len(self.words)] = 0
            met = self.words[place] == hashes
            pairs = pd.unique(doc[met] * len(self.words) + place[met])
            margin += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], len(texts))
        return _logistic(self.slope * margin + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class _Rows:
    """Documents as sorted feature numbers, back to back; every document has feature 0, the bias."""

    features: np.ndarray
    row: np.ndarray
    n: int

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.features], self.n)

    def gradient(self, residual: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.features, residual[self.row], size)


def _rows(docs: list[np.ndarray], words: np.ndarray) -> _Rows:
    features, rows = [], []
    for i, hashes in enumerate(docs):
        place = np.searchsorted(words, hashes)
        place[place == len(words)] = 0
        own = np.unique(place[words[place] == hashes]) + 1 if len(words) else np.zeros(0, np.int64)
        features.append(np.concatenate([[0], own]))
        rows.append(np.full(len(own) + 1, i))
    if not docs:
        return _Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    return _Rows(np.concatenate(features), np.concatenate(rows), len(docs))


def _vocabulary(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The words whose document shares differ most between P and U, measured in standard errors."""
    least = min(LEAST_DOCS, max(2, -(-len(positive) // 20)))
    words, in_p = np.unique(np.concatenate(positive), return_counts=True)
    words, in_p = words[in_p >= least], in_p[in_p >= least]
    all_u, count_u = np.unique(np.concatenate(unlabelled), return_counts=True) if unlabelled else (words[:0], in_p[:0])
    in_u = np.zeros(len(words))
    if len(all_u) and len(words):
        place = np.minimum(np.searchsorted(all_u, words), len(all_u) - 1)
        in_u = np.where(all_u[place] == words, count_u[place], 0)
    p, u = (in_p + 0.5) / (len(positive) + 1), (in_u + 0.5) / (len(unlabelled) + 1)
    both = (in_p + in_u + 1) / (len(positive) + len(unlabelled) + 2)
    error = np.sqrt(both * (1 - both) * (1 / max(len(positive), 1) + 1 / max(len(unlabelled), 1)))
    best = np.argsort(-np.abs(p - u) / np.maximum(error, 1e-9), kind="stable")[:VOCABULARY]
    return np.sort(words[best])


def nn_pu(p: _Rows, u: _Rows, size: int, prior: float, seed: int, steps: int = STEPS) -> np.ndarray:
    """Weights by Adam on the non-negative PU risk with the logistic loss; documents weigh as a bootstrap drew them."""
    rng = np.random.default_rng(seed)
    draw_p = np.bincount(rng.integers(0, p.n, p.n), minlength=p.n) / p.n
    draw_u = np.bincount(rng.integers(0, u.n, u.n), minlength=u.n) / u.n
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[0] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        gp, gu = p.margins(w), u.margins(w)
        as_negative = draw_u @ np.logaddexp(0, gu) - prior * (draw_p @ np.logaddexp(0, gp))
        grad = p.gradient(-prior * draw_p * _logistic(-gp), size)
        negative = u.gradient(draw_u * _logistic(gu), size) - p.gradient(prior * draw_p * _logistic(gp), size)
        grad = grad + negative if as_negative >= 0 else -negative
        grad[1:] += 1e-4 * w[1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _line(margin: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic line through labelled margins (Newton steps, targets kept off 0 and 1).

    Rows weigh so that positives make up ``share`` of them, in whatever numbers the sample holds them.
    """
    in_sample = label.mean() if len(label) else 0.0
    if not 0 < in_sample < 1:
        return 1.0, 0.0
    weight = np.where(label == 1, share / in_sample, (1 - share) / (1 - in_sample))
    positives, negatives = share * len(label), (1 - share) * len(label)
    target = np.where(label == 1, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        q = _logistic(x @ beta)
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (weight * (q - target))), -2, 2)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], labelled: list[np.ndarray], labels: np.ndarray, prior: float, share: float | None = None) -> Model:
    """A model from the word hashes of documents. Without positives or unlabelled texts every score is 0.

    ``share`` is that of toxic documents among all, where it isn't the prior.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    words = _vocabulary(positive, unlabelled)
    return _trained(words, *(_rows(docs, words) for docs in (positive, unlabelled, labelled)), labels, prior, share)


def _trained(words: np.ndarray, p: _Rows, u: _Rows, labelled: _Rows, labels: np.ndarray, prior: float, share: float | None) -> Model:
    w = np.mean([nn_pu(p, u, len(words) + 1, prior, seed) for seed in range(MODELS)], axis=0)
    share = prior if share is None else share
    slope, shift = _line(labelled.margins(w), labels, share) if labelled.n else (1.0, 0.0)
    return Model(words, w[1:], float(w[0]), slope, shift)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, 1, _BYTES):
            hashes, doc = word_hashes(batch.column(1))
            found = [np.unique(hashes[a:b]).astype(np.int64) for a, b in zip(*(np.searchsorted(doc, np.arange(batch.num_rows), s) for s in ("left", "right")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["role", "words"]
            )


def _counted_vocabulary(sample: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """``_vocabulary`` of a table of documents (role, words): counted on the cluster, ``VOCABULARY`` words come back."""
    least = min(LEAST_DOCS, max(2, -(-n_p // 20)))
    counted = sample.where("role < 2").select("role", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.when(F.col("role") == 0, True)).alias("in_p"), F.count(F.when(F.col("role") == 1, True)).alias("in_u")
    )
    p, u = (F.col("in_p") + 0.5) / (n_p + 1), (F.col("in_u") + 0.5) / (n_u + 1)
    both = (F.col("in_p") + F.col("in_u") + 1) / (n_p + n_u + 2)
    error = F.sqrt(both * (1 - both) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    # Words are unsigned numbers: negative ones come last.
    order = (F.desc(F.abs(p - u) / F.greatest(error, F.lit(1e-9))), F.col("word") < 0, F.col("word"))
    best = counted.where(F.col("in_p") >= least).orderBy(*order).limit(VOCABULARY).select("word").toArrow()
    return np.sort(best.column("word").to_numpy().astype(np.uint64))


def _numbered(sample: DataFrame, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Role and sorted feature numbers (0 is the bias) of each document; two bytes a feature reach the driver."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype(np.uint64)[at[0] : at[-1]]
            place = np.searchsorted(words, values)
            place[place == len(words)] = 0
            met = words[place] == values if len(words) else np.zeros(len(values), bool)
            ends = np.concatenate([[0], np.cumsum(met)])[at - at[0]]
            features = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((place[met] + 1).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), features], names=["role", "features"])

    rows = sample.mapInArrow(number, "role int, features array<smallint>").toArrow()
    lists = rows.column("features").combine_chunks()
    at, values = np.asarray(lists.offsets), np.asarray(lists.values).astype(np.int64)
    return rows.column("role").to_numpy(), [np.concatenate([[0], np.sort(values[a:b])]) for a, b in zip(at[:-1], at[1:])]


def _stacked(docs: list[np.ndarray]) -> _Rows:
    sizes = [len(d) for d in docs]
    return _Rows(np.concatenate(docs) if docs else np.zeros(0, np.int64), np.repeat(np.arange(len(docs)), sizes), len(docs))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """A model for ``docs`` (doc_id, text) from ``labels`` (doc_id, toxic) of the rows that are not held out.

    The prior is the given one, else the share of toxic rows among the labels that may be learned from.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    share = prior or usable.agg(F.avg("toxic")).first()[0]
    prior = prior if prior is not None else min(max(share or PRIOR, 0.01), 0.9)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))

    def first(rows: DataFrame, n: int, role: int) -> DataFrame:
        return rows.select(F.col("doc_id").alias("__id")).orderBy(order, "__id").limit(n).withColumn("role", F.lit(role))

    usable = usable.withColumnRenamed("toxic", "__toxic")
    # An id labelled both ways counts as toxic.
    order_rows = usable.groupBy("doc_id").agg(F.max("__toxic").alias("__toxic"))
    chosen = (
        first(order_rows.where("__toxic = 1"), POSITIVES, 0)
        .unionByName(first(docs.where(F.col("doc_id").isNotNull()), UNLABELLED, 1))
        .unionByName(first(order_rows.where("__toxic = 0"), CALIBRATION, 2))
    )
    # At most POSITIVES + UNLABELLED + CALIBRATION ids.
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    sample = keep(sample.select("role", "text").mapInArrow(_distinct_words, "role int, words array<bigint>"), "toxicity-sample")
    sizes = {r["role"]: r["count"] for r in sample.groupBy("role").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    words = _counted_vocabulary(sample, sizes[0], sizes[1])
    roles, numbered = _numbered(sample, words)
    by_role = [[numbered[i] for i in np.flatnonzero(roles == r)] for r in range(3)]
    known = np.concatenate([np.ones(len(by_role[0])), np.zeros(len(by_role[2]))])
    # The samples are cut at unlike shares; labelled rows enter the line in the share of all labels, or the given prior.
    return _trained(words, _stacked(by_role[0]), _stacked(by_role[1]), _stacked(by_role[0] + by_role[2]), known, prior, share)


def score_column(model: Model, text: str | Column = "text") -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string())], names=["text"])
            parts = [model.scores(part.column(0)) for part in by_size(batch, 0, _BYTES)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(whole_text(text))


def toxicity_scores(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    A null text is an empty one and gets the score of no words. A null id is not held out. Rows that repeat score alike.
    Without positive labels all scores are next to 0; empty input gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, prior)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, all columns."""
    model = fit(docs, labels, prior)
    return docs.withColumn("__score", score_column(model)).where(F.col("__score") < threshold).select(*docs.columns)
