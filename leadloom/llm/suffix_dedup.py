"""Removal of byte strings that occur twice, by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere else. Each window of that length belongs
to an anchor: the start of the piece of ``PIECE`` bytes in it with the smallest hash, so equal windows belong to anchors
with equal pieces. One anchor stands for about ``(LENGTH - PIECE) / 2`` windows, and its context is what they cover.

1. Anchors whose piece occurs once in the corpus have no equal window and drop out (a count by hash).
2. Of the rest, equal contexts are counted. A piece with one context only is decided: all its windows recur.
3. Pieces with several contexts: their distinct contexts are gathered in bounded groups, and the suffixes at their windows
   are sorted. Prefix polynomial hashes with a binary search find the common extension of two suffixes, which makes a
   comparison logarithmic, and a bottom-up mergesort orders them, all in numpy. Neighbours that share ``LENGTH`` bytes by
   hash are compared byte by byte before they count.
4. A piece with more contexts than a group may hold is decided by counting its windows' contents, spread over the
   cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, text_bytes
from leadloom.llm.common import keep, whole_text

LENGTH, PIECE = 200, 50
#: Contexts that one sorting group gathers, and the most of one piece that are sorted in one.
GROUP, MOST = 4_096, 4_096
_BYTES = 2 << 20
_PLACE_BITS = 26
_SEGMENT = 32 << 20

_rng = np.random.default_rng(9)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_VALUES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2^64."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    known = _powers[inverse]
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    _powers[inverse] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * powers(len(data)), dtype=np.uint64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first window's start, number of windows, anchor's place, hash of its piece); windows stay in a text."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(data) < LENGTH:
        return empty
    prefix = prefix_hashes(data)
    n = len(data) - PIECE + 1
    value = _mixed((prefix[PIECE:] - prefix[:-PIECE]) * powers(n, inverse=True))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # The place in the low bits: the leftmost of equal pieces.
    least = _sliding_min((value & ~low) | np.arange(n, dtype=np.uint64), LENGTH - PIECE + 1)
    anchor = (least & low).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + LENGTH <= offsets[doc + 1]
    start, doc, anchor = start[inside], doc[inside], anchor[inside]
    if not len(start):
        return empty
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(start)))
    return doc[at], start[at] - offsets[doc[at]], size, anchor[at] - offsets[doc[at]], value[anchor[at]]


def _segments(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, row and first byte of each text; a very long text in segments that share all but a window's bytes."""
    for part, first in _parts(batch, column):
        offsets, data = text_bytes(part.column(column))
        if len(data) <= _SEGMENT:
            yield data, offsets, np.arange(first, first + part.num_rows), np.zeros(part.num_rows, np.int64)
            continue
        for row in range(part.num_rows):
            own = data[offsets[row] : offsets[row + 1]]
            for at in range(0, max(len(own) - LENGTH + 1, 1), _SEGMENT):
                piece = own[at : at + _SEGMENT + LENGTH - 1]
                yield piece, np.array([0, len(piece)]), np.array([first + row]), np.array([at])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    first = 0
    for part in by_size(batch, column, _BYTES):
        yield part, first
        first += part.num_rows


def _anchor_rows(batches: Iterator[pa.RecordBatch], named: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, offsets, rows, base in _segments(batch, batch.num_columns - 1):
            doc, start, size, anchor, piece = anchors(data, offsets)
            columns = {"piece": pa.array(piece.astype(np.int64))}
            if named:
                at = pa.array(rows[doc])
                columns |= {"doc_id": batch.column(0).take(at), "mark": batch.column(1).take(at)}
                columns["place"] = pa.array((start + base[doc]) << 16 | (anchor - start) << 8 | size)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _context_rows(batches: Iterator[pa.RecordBatch], bytes_too: bool) -> Iterator[pa.RecordBatch]:
    """For rows (doc_id, mark, text, anchors): each anchor's piece, context digest, id, mark, place, and the context.

    An anchor is (piece, start << 16 | its own place from there << 8 | windows); the middle part follows from the context.
    """
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("piece", "digest", "doc_id", "mark", "place", "context")}
        texts = batch.column(2).cast(pa.binary())
        for doc_id, mark, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
            data = text.as_py()
            for anchor in own:
                start, size = anchor["place"] >> 16, anchor["place"] & 0xFF
                context = data[start : start + size - 1 + LENGTH]
                out["piece"].append(anchor["piece"])
                out["digest"].append(hashlib.blake2b(context, digest_size=16).digest())
                out["doc_id"].append(doc_id)
                out["mark"].append(mark)
                out["place"].append(anchor["place"])
                out["context"].append(context)
        kinds = {"digest": pa.binary(), "context": pa.binary()}
        if not bytes_too:
            del out["context"]
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


class Suffixes:
    """Suffixes of a byte buffer, compared by prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.prefix = prefix_hashes(data)
        self.power = powers(len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes, at most ``LENGTH``, that the suffixes at ``a`` and ``b`` share by hash: a binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        last = len(self.data)
        scale_a, scale_b = self.power[last - a], self.power[last - b]
        from_a, from_b = self.prefix[a], self.prefix[b]
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = (self.prefix[a + middle] - from_a) * scale_a == (self.prefix[b + middle] - from_b) * scale_b
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` is smaller (or equal, where asked) than the one at ``b``."""
        size = self.common(a, b)
        same = size >= LENGTH
        at = np.minimum(size, LENGTH - 1)
        return np.where(same, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes by group and content: a bottom-up mergesort, all merges of a level at once.

        Each element finds by binary search how many of the other run come before it.
        """
        order = np.argsort(group, kind="stable")
        grouped = group[order]
        first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(group)) - begin
        width = 1
        while len(size) and width < size.max():
            active = np.flatnonzero(count > width)
            own = place[active]
            run = own // width
            other = (run ^ 1) * width
            low = np.minimum(other, count[active])
            high = np.minimum(other + width, count[active])
            base, left = low.copy(), run % 2 == 0
            mine = start[order[active]]
            while (low < high).any():
                open_ = np.flatnonzero(low < high)
                middle = (low[open_] + high[open_]) // 2
                theirs = start[order[begin[active[open_]] + middle]]
                before = self.less(theirs, mine[open_], ~left[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = begin[active] + (run // 2) * 2 * width + (own - run * width) + (low - base)
            merged = order.copy()
            merged[target] = order[active]
            order = merged
            width *= 2
        return order

    def equal_neighbours(self, order: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether each suffix and its follower in ``order`` share ``LENGTH`` bytes; hash matches are verified."""
        a, b = start[order[:-1]], start[order[1:]]
        same = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        same = same[self.common(a[same], b[same]) >= LENGTH]
        span = np.arange(LENGTH)
        out = np.zeros(max(len(order) - 1, 0), bool)
        for i in range(0, len(same), 20_000):
            part = same[i : i + 20_000]
            out[part] = (self.data[a[part][:, None] + span] == self.data[b[part][:, None] + span]).all(1)
        return out


def repeated_windows(pieces: list[int], contexts: list[bytes], places: list[int], counts: list[int]) -> list[np.ndarray]:
    """For distinct contexts of anchors: which windows of each also occur elsewhere.

    ``pieces`` names equal anchors, ``places`` says where they lie in their contexts.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    windows = size - LENGTH + 1
    begins = np.cumsum(size) - size
    suffixes = Suffixes(np.frombuffer(b"".join(contexts), np.uint8))
    owner = np.repeat(np.arange(len(contexts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    # Equal windows have their piece at the same distance, so only they have to be sorted together.
    distance = np.array(places, np.int64)[owner] - (start - begins[owner])
    names = np.unique(np.array(pieces, np.int64), return_inverse=True)[1]
    group = names[owner] * (LENGTH + 1) + distance
    order = suffixes.sort(start, group)
    equal = suffixes.equal_neighbours(order, start, group)
    again = np.zeros(len(start), bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    again |= np.array(counts)[owner] > 1
    return np.split(again, np.cumsum(windows)[:-1])


def _spans(again: np.ndarray) -> list[int]:
    """Runs of set windows as first << 16 | number."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    return [int(a) << 16 | int(b - a) for a, b in zip(edges[::2], edges[1::2])]


def _sorted_group(frame: pd.DataFrame) -> pd.DataFrame:
    again = repeated_windows(frame["piece"].tolist(), frame["context"].tolist(), frame["place"].tolist(), frame["n"].tolist())
    return pd.DataFrame({"piece": frame["piece"], "digest": frame["digest"], "runs": [_spans(a) for a in again]})


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (piece, digest, context, n): every window's number and the digest of its content."""
    for batch in batches:
        out: list[tuple] = []
        for piece, digest, context, n in zip(*(c.to_pylist() for c in batch.columns)):
            for i in range(len(context) - LENGTH + 1):
                out.append((piece, digest, i, hashlib.blake2b(context[i : i + LENGTH], digest_size=16).digest(), n))
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["piece", "digest", "window", "content", "n"]
        )


def _runs_of(windows: pd.Series) -> pd.Series:
    out = []
    for own in windows:
        flags = np.zeros(max(own) + 1, bool)
        flags[np.asarray(own)] = True
        out.append(_spans(flags))
    return pd.Series(out)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (doc_id, text, spans: start << 16 | windows): what is left of the text."""
    for batch in batches:
        rows = []
        texts = batch.column(1).cast(pa.binary())
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
            data = np.frombuffer(text.as_py(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            own = np.array(spans or [], np.int64)
            np.add.at(edge, own >> 16, 1)
            np.add.at(edge, (own >> 16) + (own & 0xFFFF) - 1 + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            rows.append((doc_id, len(data), int(gone.sum()), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _same_row(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["__id"]) & (left["mark"] == right["__mark"])


def _verdicts(occurrences: DataFrame, touched: DataFrame) -> DataFrame:
    """``piece, digest, runs`` (null: all windows) of the contexts with windows that recur."""
    counted = keep(occurrences.groupBy("piece", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "place")).alias("one")), "contexts")
    variety = keep(counted.groupBy("piece").agg(F.count("*").alias("m")), "pieces")
    whole = counted.join(variety.where("m = 1").select("piece"), "piece").where("n > 1").select("piece", "digest", F.lit(None).cast("array<bigint>").alias("runs"))
    open_ = counted.join(variety.where("m > 1"), "piece").select("piece", "n", "m", "one.*")
    asked = open_.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(
        F.collect_list(F.struct("piece", "place")).alias("anchors")
    )
    texts = touched.select("doc_id", "mark", "text").dropDuplicates(["doc_id", "mark"])
    asked = keep(asked, "asked")
    rows = texts.join(asked, _same_row(texts, asked)).select("doc_id", "mark", "text", "anchors")
    contexts = rows.mapInArrow(
        lambda b: _context_rows(b, True), "piece bigint, digest binary, doc_id bigint, mark bigint, place bigint, context binary"
    )
    counts = keep(open_.select("piece", "doc_id", "mark", "place", "n", "m"), "open")
    contexts = contexts.join(
        counts.withColumnRenamed("doc_id", "__id"),
        ["piece", "mark", "place"],
    ).where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("piece", "digest", "context", F.shiftright("place", 8).bitwiseAND(0xFF).alias("place"), "n", "m")
    contexts = keep(contexts, "open-contexts")
    groups = max(1, -(-contexts.where(F.col("m") <= MOST).count() * 2 // GROUP))
    decided = (
        contexts.where(F.col("m") <= MOST)
        .groupBy(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"))
        .applyInPandas(lambda frame: _sorted_group(frame), "piece bigint, digest binary, runs array<bigint>")
    )
    many = contexts.where(F.col("m") > MOST)
    if not many.isEmpty():
        windows = keep(
            many.select("piece", "digest", "context", "n").mapInArrow(
                _window_rows, "piece bigint, digest binary, window int, content binary, n bigint"
            ),
            "windows",
        )
        recurs = keep(windows.groupBy("piece", "content").agg(F.sum("n").alias("total")).where("total > 1"), "recurring-windows")
        flagged = windows.join(recurs, ["piece", "content"]).groupBy("piece", "digest").agg(F.collect_list("window").alias("own"))
        runs = F.pandas_udf(_runs_of, "array<bigint>")
        decided = decided.unionByName(flagged.select("piece", "digest", runs("own").alias("runs")))
    return whole.unionByName(decided.where(F.size("runs") > 0))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the other bytes).

    Strings are judged on the input, overlapping ones and those within one document included; matches never cross
    documents. A null text is empty. Rows that repeat are occurrences of their own, so their windows recur; null ids
    stay. Texts shorter than the length lose nothing. Empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    pieces = rows.select("text").mapInArrow(lambda b: _anchor_rows(b, False), "piece bigint")
    shared = keep(pieces.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece"), "shared-pieces")
    marked = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    named = marked.mapInArrow(lambda b: _anchor_rows(b, True), "piece bigint, doc_id bigint, mark bigint, place bigint")
    held = keep(named.join(shared, "piece"), "shared-anchors")
    lists = held.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(
        F.collect_set(F.struct("piece", "place")).alias("anchors")
    )
    lists = keep(lists, "anchors-of-texts")
    # Texts without a shared piece are done; the others go on with their text.
    all_rows = marked.join(lists, _same_row(marked, lists), "left")
    slim = F.when(F.col("anchors").isNotNull(), F.col("text"))
    all_rows = all_rows.select(
        "doc_id", "mark", slim.alias("text"), "anchors", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.when(F.col("anchors").isNull(), F.sha2(F.col("text"), 256)).alias("kept_sha256"),
    )
    all_rows = keep(all_rows, "texts")
    touched = all_rows.where(F.col("text").isNotNull()).select("doc_id", "mark", "text", "anchors")
    occurrences = keep(
        touched.mapInArrow(lambda b: _context_rows(b, False), "piece bigint, digest binary, doc_id bigint, mark bigint, place bigint"),
        "occurrences",
    )
    verdicts = keep(_verdicts(occurrences, touched), "verdicts")
    met = occurrences.join(verdicts, ["piece", "digest"])
    start, size = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFF)
    own_runs = F.transform("runs", lambda r: F.shiftleft(start + F.shiftright(r, 16), 16).bitwiseOR(r.bitwiseAND(0xFFFF)))
    whole = F.array(F.shiftleft(start, 16).bitwiseOR(size))
    spans = met.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.explode(F.coalesce(own_runs, whole)).alias("span"))
    spans = keep(spans.groupBy("__id", "__mark").agg(F.collect_set("span").alias("spans")), "removed-spans")
    asked = touched.join(spans, _same_row(touched, spans), "left").select("doc_id", "text", "spans")
    done = all_rows.where(F.col("text").isNull()).select(
        "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), "kept_sha256"
    )
    return asked.mapInArrow(_removed, _RESULT).unionByName(done)
