"""Secret scans: fixed patterns, and a linear-chain conditional random field over the tokens of each line.

The patterns give the base spans, which always stay. The field tags tokens as begin, inside or outside of a secret from
their shape, the words before them and features of the file; it is trained with numpy on a bounded sample of token runs
whose labels come from the base spans, and decoded by Viterbi. Its spans are added where they touch no base span.

Tokens and features of a whole Arrow batch are computed at once over its bytes. A line is decoded only if some token
could be better off inside a secret even with the best transitions; for all other lines "outside" throughout is the best
path, so leaving them out changes nothing. No shuffle moves a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, hash_runs, text_bytes
from leadloom.llm.common import whole_text

#: The base patterns and the least length of what counts, in the order of the kinds.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that often stand before a secret.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials")
#: Documents of the training sample (the first in the order of a hash), token runs and tokens of a run that are learned from.
SAMPLE_DOCS, RUNS, RUN = 8_000, 1_500, 48
STEPS = 120
_BYTES = 4 << 20
SPAN_COLUMNS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

# Feature groups: sizes, back to back.
_GROUPS = (8 * 32, 2 * 4 * 4, 4 * 4, 33, 2 * 3)
_AT = np.concatenate([[0], np.cumsum(_GROUPS)])
N_FEATURES = int(_AT[-1])
BEGIN, INSIDE, OUTSIDE = range(3)


def base_spans(text: str, values: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted: whole matches, or of an assignment its value alone."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(2 if values else 0), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of 24 or more within the maximal run: the same runs as HEX gives after the length test.
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _table(test) -> np.ndarray:
    return np.array([test(i) for i in range(256)])


_IN_TOKEN = _table(lambda i: i >= 128 or chr(i).isalnum() or chr(i) in "+/_.=-")
_SHAPE = _table(
    lambda i: 16 if i >= 128 else 1 if chr(i).islower() else 2 if chr(i).isupper() else 4 if chr(i).isdigit() else 8
).astype(np.uint8)
_HEX_BYTE = _table(lambda i: i < 128 and chr(i) in "0123456789abcdefABCDEF")
_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)
_BEFORE = _table(lambda i: 1 if i in b"\"'`" else 2 if i in b":=" else 3 if i in b" \t" else 0).astype(np.int64)
_STEPS = np.array([4, 8, 12, 16, 24, 40, 64])


@dataclass
class Tokens:
    """Tokens of a batch: byte starts and ends, text number, whether a line begins, features (one number per group)."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    features: np.ndarray


def _keyword_hashes() -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in KEYWORDS]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(hash_runs(np.concatenate(raw), ends - [len(r) for r in raw], ends))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of letters, digits, ``+/_.=-`` and non-ASCII characters, with their features."""
    inner = _IN_TOKEN[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= inner[1:] != inner[:-1]
    at = np.flatnonzero(cut)
    if len(at) < 2:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none.astype(bool), np.zeros((0, len(_GROUPS)), np.int64))
    shape_of = _SHAPE[data]
    ink = inner[at[:-1]]
    starts, ends = at[:-1][ink], at[1:][ink]
    shape = np.bitwise_or.reduceat(shape_of, at[:-1])[ink].astype(np.int64)
    digits = np.add.reduceat((shape_of == 4).astype(np.int32), at[:-1])[ink]
    changes = np.zeros(len(data), np.int32)
    changes[1:] = shape_of[1:] != shape_of[:-1]
    turns = np.add.reduceat(changes, at[:-1])[ink]
    is_hex = np.logical_and.reduceat(_HEX_BYTE[data], at[:-1])[ink]
    size = ends - starts
    doc = np.searchsorted(offsets, starts, "right") - 1
    lines = np.cumsum(data == 10)[starts] if len(data) else starts
    first = np.ones(len(starts), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (lines[1:] != lines[:-1])

    length = np.searchsorted(_STEPS, size, "right")
    share = np.minimum(digits * 4 // np.maximum(size, 1), 3)
    turn = np.minimum(turns * 8 // np.maximum(size, 1), 3)
    short = (size <= 12) & (size >= 3)
    keyword = np.zeros(len(starts), bool)
    if short.any():
        keyword[short] = np.isin(hash_runs(_LOWER[data], starts[short], ends[short]), _keyword_hashes())
    near = np.zeros(len(starts), np.int64)
    run = np.cumsum(first)
    for back in (3, 2, 1):
        if len(starts) > back:
            near[back:][keyword[:-back] & (run[back:] == run[:-back])] = back
    before = np.zeros(len(starts), np.int64)
    inside = starts > offsets[doc]
    before[inside] = _BEFORE[data[starts[inside] - 1]]
    following = np.full(len(starts), 32, np.int64)
    following[:-1][~first[1:]] = shape[1:][~first[1:]]
    odd = np.concatenate([[0], np.cumsum((shape_of == 4) | (shape_of == 8))])
    chars = np.maximum(np.diff(offsets), 1)
    file = np.minimum((odd[offsets[1:]] - odd[offsets[:-1]]) * 5 // chars, 2)[doc]
    groups = (length * 32 + shape, is_hex * 16 + share * 4 + turn, near * 4 + before, following, first * 3 + file)
    return Tokens(starts, ends, doc, first, np.stack([g + a for g, a in zip(groups, _AT)], 1).astype(np.int64))


def labels_of(tokens: Tokens, points: np.ndarray, offsets: np.ndarray, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Begin, inside or outside for each token, from base spans (code points) of each text."""
    labels = np.full(len(tokens.starts), OUTSIDE)
    for doc, own in enumerate(spans):
        a, b = np.searchsorted(tokens.doc, [doc, doc + 1])
        for start, _, end in own:
            left = points[tokens.starts[a:b]] - points[offsets[doc]]
            right = points[tokens.ends[a:b]] - points[offsets[doc]]
            hit = np.flatnonzero((left < end) & (right > start)) + a
            labels[hit] = np.where(labels[hit] == OUTSIDE, INSIDE, labels[hit])
            if len(hit):
                labels[hit[0]] = BEGIN
    return labels


@dataclass
class Field:
    """Weights of the features for each tag, of tag pairs, and of the first tag."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = self.emission[features[:, 0]].copy()
        for group in range(1, features.shape[1]):
            total += self.emission[features[:, group]]
        return total

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of one line."""
        step = self.transition.tolist()
        best = (scores[0] + self.start).tolist()
        back = []
        for own in scores[1:].tolist():
            came = [max(range(3), key=lambda i, j=j: best[i] + step[i][j]) for j in range(3)]
            best = [best[came[j]] + step[came[j]][j] + own[j] for j in range(3)]
            back.append(came)
        tag = max(range(3), key=best.__getitem__)
        tags = [tag]
        for came in reversed(back):
            tag = came[tag]
            tags.append(tag)
        return tags[::-1]

    def tagged_lines(self, tokens: Tokens) -> Iterator[tuple[int, list[int]]]:
        """(first token, tags) of each line whose best path is not outside throughout."""
        if not len(tokens.starts):
            return
        scores = self.scores(tokens.features)
        gain = max(0.0, float(self.transition.max() - self.transition[OUTSIDE, OUTSIDE]))
        at_start = max(0.0, float(self.start.max() - self.start[OUTSIDE]))
        could = scores[:, :OUTSIDE].max(1) - scores[:, OUTSIDE] + 2 * gain + at_start > 0
        begins = np.flatnonzero(tokens.first)
        ends = np.append(begins[1:], len(tokens.starts))
        for line in np.flatnonzero(np.logical_or.reduceat(could, begins)):
            a, b = int(begins[line]), int(ends[line])
            yield a, self.viterbi(scores[a:b])


def train(features: np.ndarray, labels: np.ndarray, size: np.ndarray, steps: int = STEPS) -> Field:
    """Adam on the regularised log-likelihood; ``features`` (runs, tokens, groups), ``labels``, run lengths ``size``."""
    n, t = labels.shape
    field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    if not n:
        field.start[OUTSIDE] = field.transition[:, OUTSIDE] = 20.0
        return field
    inside = np.arange(t)[None] < size[:, None]
    own = np.zeros((n, t, 3))
    np.put_along_axis(own, labels[..., None], 1.0, 2)
    own *= inside[..., None]
    pairs = np.einsum("nti,ntj->ij", own[:, :-1], own[:, 1:])
    moments = [np.zeros(N_FEATURES * 3 + 12) for _ in range(2)]
    theta = np.zeros(N_FEATURES * 3 + 12)

    def unpack() -> None:
        field.emission = theta[: N_FEATURES * 3].reshape(-1, 3)
        field.transition = theta[N_FEATURES * 3 : N_FEATURES * 3 + 9].reshape(3, 3)
        field.start = theta[-3:]

    flat = features[inside]
    for step in range(1, steps + 1):
        unpack()
        e = np.zeros((n, t, 3))
        e[inside] = field.scores(flat)
        alpha, beta = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        alpha[:, 0] = field.start + e[:, 0]
        for i in range(1, t):
            moved = np.logaddexp.reduce(alpha[:, i - 1, :, None] + field.transition, axis=1) + e[:, i]
            alpha[:, i] = np.where(inside[:, i, None], moved, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            moved = np.logaddexp.reduce(field.transition + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(inside[:, i + 1, None], moved, 0)
        whole = np.logaddexp.reduce(alpha[:, -1], axis=1)
        marginal = np.exp(alpha + beta - whole[:, None, None]) * inside[..., None]
        joint = alpha[:, :-1, :, None] + field.transition + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected = (np.exp(joint) * inside[:, 1:, None, None]).sum((0, 1))
        wrong = (marginal - own)[inside]
        grad = np.zeros_like(theta)
        emission = grad[: N_FEATURES * 3].reshape(-1, 3)
        for group in range(flat.shape[1]):
            for tag in range(3):
                emission[:, tag] += np.bincount(flat[:, group], wrong[:, tag], N_FEATURES)
        grad[N_FEATURES * 3 : N_FEATURES * 3 + 9] = (expected - pairs).ravel()
        grad[-3:] = (marginal[:, 0] - own[:, 0]).sum(0)
        grad = grad / n + 1e-4 * theta
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        theta = theta - 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
    unpack()
    return field


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training runs: of each text those with a secret, and the first without."""
    for whole in batches:
        for batch in by_size(whole, 0, _BYTES):
            offsets, data = text_bytes(batch.column(0))
            tokens = tokens_of(data, offsets)
            spans = [base_spans(t, values=True) for t in batch.column(0).to_pylist()]
            labels = labels_of(tokens, _points(data), offsets, spans)
            features, tags = [], []
            begins = np.flatnonzero(tokens.first)
            plain = set()
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(tokens.starts)).tolist()):
                for i in range(a, b, RUN):
                    own = labels[i : min(i + RUN, b)]
                    doc = int(tokens.doc[i])
                    if (own == OUTSIDE).all():
                        if doc in plain:
                            continue
                        plain.add(doc)
                    features.append(tokens.features[i : i + len(own)].ravel())
                    tags.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.int64())) for x in (features, tags)], names=["features", "tags"]
            )


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """A field from the base spans of a bounded sample of documents."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets"))
    chosen = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).orderBy(order, "__id").limit(sample).distinct()
    # At most ``sample`` ids.
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(whole_text().alias("text"))
    runs = texts.mapInArrow(_runs, "features array<bigint>, tags array<bigint>")
    secret = F.exists("tags", lambda tag: tag != OUTSIDE)
    half = RUNS // 2
    by_hash = F.xxhash64("features", "tags")
    rows = runs.where(secret).orderBy(by_hash).limit(half).unionByName(runs.where(~secret).orderBy(by_hash).limit(half)).toArrow()
    groups = len(_GROUPS)
    features = [np.array(x, np.int64).reshape(-1, groups) for x in rows.column("features").to_pylist()]
    tags = [np.array(x, np.int64) for x in rows.column("tags").to_pylist()]
    size = np.array([len(x) for x in tags], np.int64)
    x, y = np.zeros((len(tags), RUN, groups), np.int64), np.full((len(tags), RUN), OUTSIDE)
    for i, (own, tag) in enumerate(zip(features, tags)):
        x[i, : len(tag)], y[i, : len(tag)] = own, tag
    return train(x, y, size) if (y != OUTSIDE).any() else train(x[:0], y[:0], size[:0])


def scan(texts: pa.Array, field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text; the added ones are free of base spans."""
    offsets, data = text_bytes(texts)
    tokens = tokens_of(data, offsets)
    base = [base_spans(t) for t in texts.to_pylist()]
    added: list[list[tuple[int, int, int]]] = [[] for _ in base]
    points = _points(data)
    for at, tags in field.tagged_lines(tokens):
        doc = int(tokens.doc[at])
        zero = points[offsets[doc]]
        i = 0
        while i < len(tags):
            if tags[i] == OUTSIDE:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            start, end = int(points[tokens.starts[at + i]] - zero), int(points[tokens.ends[at + j - 1]] - zero)
            if not any(s < end and e > start for s, _, e in base[doc]):
                added[doc].append((start, 3, end))
            i = j
    return list(zip(base, added))


def _rows(texts: pa.Array, field: Field) -> pd.DataFrame:
    rows = []
    for base, added in scan(texts, field):
        count = [sum(kind == k for _, kind, _ in base) for k in range(3)]
        rows.append((*count, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def span_column(field: Field, text: str | Column = "text") -> Column:
    @F.pandas_udf(SPAN_COLUMNS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string())], names=["text"])
            yield pd.concat([_rows(part.column(0), field) for part in by_size(batch, 0, _BYTES)] or [_rows(batch.column(0), field)], ignore_index=True)

    return spans(whole_text(text))


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, code points).

    A null text is an empty one, without spans. Repeated rows repeat their result; null ids stay. Without any base span
    in the sample nothing is added. Empty input gives no rows; other columns are ignored.
    """
    found = docs.select("doc_id", span_column(fit(docs)).alias("__found"))
    return found.select("doc_id", "__found.*")
