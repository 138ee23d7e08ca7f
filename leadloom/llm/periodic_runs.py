"""Periodic runs of words by internal pattern matching.

A run is a longest stretch of words whose smallest period ``q`` fits into it at least ``LEAST_REPEATS`` times. A run whose
period lies in ``[2^k, 2^(k+1))`` holds a dyadic block (``2^k`` words, aligned to ``2^k``) whose content occurs again one
period later. So for every ``k`` the blocks are queries: their occurrences that begin in the neighbouring window of
``2^k`` places are counted and selected by a wavelet tree over the suffix array (range successor in the suffix range of
the block). All occurrences in such a window form one arithmetic progression, so the first two and their number name all of
them; each distance is a candidate period, which common extensions to both sides confirm or reject.

All texts of an Arrow slice are searched at once. Blocks are asked only where every word recurs within ``2^(k+1)`` places,
which holds for each block inside a run with such a period; suffix array, prefix ranks and wavelet tree cover the
surroundings of these blocks. Time is O(n log n) for n words, memory about ``8 log2 n`` bytes a word of the surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, hash_runs, text_bytes
from leadloom.llm.common import whole_text

LEAST_WORDS = 6
LEAST_REPEATS = 4
_BYTES = 2 << 20
_NO = np.iinfo(np.int64).max // 4

# Fixed value: the white space between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class WaveletTree:
    """Counts and selections among ``values[lo:hi]``, one packed bit vector per binary digit (highest first)."""

    def __init__(self, values: np.ndarray, limit: int):
        self.digits = max(1, int(limit).bit_length())
        self.levels = []
        rest = values.astype(np.int64)
        for digit in range(self.digits - 1, -1, -1):
            ones = (rest >> digit) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((words, before, len(ones) - int(ones.sum())))
            rest = np.concatenate([rest[~ones], rest[ones]])

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        words, before, _ = level
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & below)

    def count_below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values are less than ``bound``, which must have no more digits than the limit."""
        found = np.zeros(len(lo), np.int64)
        for i, level in enumerate(self.levels):
            one = (bound >> (self.digits - 1 - i)) & 1 == 1
            l1, h1 = self._ones(level, lo), self._ones(level, hi)
            found += np.where(one, (hi - h1) - (lo - l1), 0)
            lo, hi = np.where(one, level[2] + l1, lo - l1), np.where(one, level[2] + h1, hi - h1)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value number ``k`` (from 0) in increasing order; it must exist."""
        value = np.zeros(len(lo), np.int64)
        for level in self.levels:
            l1, h1 = self._ones(level, lo), self._ones(level, hi)
            zeros = (hi - h1) - (lo - l1)
            one = k >= zeros
            value = value * 2 + one
            k = np.where(one, k - zeros, k)
            lo, hi = np.where(one, level[2] + l1, lo - l1), np.where(one, level[2] + h1, hi - h1)
        return value


class PrefixRanks:
    """The suffix array by the first ``2^top`` words, and for each ``k`` the place where a suffix's ``2^k``-range begins."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        self.ranks, key = [], symbols.astype(np.int64)
        for k in range(top + 1):
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            rank = np.empty(n, np.int32)
            rank[order] = np.repeat(first, np.diff(np.append(first, n)))
            self.ranks.append(rank)
            self.order = order
            half = 1 << k
            after = np.full(n, -1, np.int64)
            after[: max(n - half, 0)] = rank[half:]
            key = rank.astype(np.int64) * (n + 1) + after + 1

    def range_of(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.bincount(self.ranks[k], minlength=len(self.ranks[k]))
        lo = self.ranks[k][at].astype(np.int64)
        return lo, lo + sizes[lo]

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at ``i`` and ``j`` (``i < j``)."""
        return self._common(i, j, 1)

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common end of what stands before ``i`` and ``j`` (``i < j``)."""
        return self._common(i, j, -1)

    def _common(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        n, length = len(self.ranks[0]), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            step = 1 << k
            # The longest blocks may match again and again, each shorter one at most once after that.
            go = np.arange(len(i))
            while len(go):
                a, b = i[go] + way * length[go], j[go] + way * length[go]
                if way < 0:
                    a, b = a - step, b - step
                inside = (a >= 0) & (b + step <= n)
                same = np.zeros(len(go), bool)
                same[inside] = self.ranks[k][a[inside]] == self.ranks[k][b[inside]]
                go = go[same]
                length[go] += step
                if k < len(self.ranks) - 1:
                    break
        return length


def _active_blocks(symbols: np.ndarray, text: np.ndarray, top: int) -> list[np.ndarray]:
    """For each ``k`` the aligned blocks all of whose words recur, in the same text, within ``2^(k+1)`` places."""
    n = len(symbols)
    order = np.lexsort((np.arange(n), symbols, text))
    again = (symbols[order[1:]] == symbols[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    gap = np.full(n, _NO, np.int64)
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    found, widest = [], gap
    for k in range(top + 1):
        found.append(np.flatnonzero(widest < 2 << k) << k)
        pairs = len(widest) // 2
        widest = np.maximum(widest[0 : 2 * pairs : 2], widest[1 : 2 * pairs : 2])
    return found


def _surroundings(blocks: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (begin, end) that hold every run around an active block, and its neighbouring words."""
    edge = np.zeros(int(last[-1]) + 1, np.int64)
    for k, at in enumerate(blocks):
        if len(at):
            of = np.searchsorted(first, at, "right") - 1
            np.add.at(edge, np.maximum(at - (1 << k), first[of]), 1)
            np.add.at(edge, np.minimum(at + (4 << k), last[of]), -1)
    inside = np.cumsum(edge)[:-1] > 0
    # Texts follow each other without a gap; a stretch ends with its text.
    borders = np.zeros(len(inside) + 1, bool)
    borders[first[first < len(inside)]] = True
    borders[-1] = borders[0] = True
    change = np.concatenate([[True], inside[1:] != inside[:-1], [True]]) | borders
    at = np.flatnonzero(change)
    begin, end = at[:-1], at[1:]
    held = inside[begin]
    return begin[held], end[held]


def find_runs(
    symbols: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end (places among all symbols) and period of each run, ordered by begin, then period.

    ``symbols`` are the words of all texts back to back, ``bounds`` where each text begins, and the end; runs never cross
    texts. ``least_repeats`` must be 4 or more.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = bounds[:-1], bounds[1:]
    first, last = first[last > first], last[last > first]
    longest = int((last - first).max()) if len(first) else 0
    if longest < max(least_words, least_repeats):
        return none
    top = max(0, (longest // least_repeats).bit_length() - 1)
    blocks = _active_blocks(symbols, np.repeat(np.arange(len(first)), last - first), top)
    begin, end = _surroundings(blocks, first, last)
    if not len(begin):
        return none
    # The stretches back to back, each followed by a symbol of its own.
    sizes = end - begin + 1
    shift = np.cumsum(sizes) - sizes - begin
    values = np.unique(symbols, return_inverse=True)[1]
    joined = np.empty(int(sizes.sum()), np.int64)
    stops = np.cumsum(sizes) - 1
    kept = np.ones(len(joined), bool)
    kept[stops] = False
    joined[kept] = values[np.arange(len(joined))[kept] - np.repeat(shift, sizes)[kept]]
    joined[stops] = values.max() + 1 + np.arange(len(stops))
    top = min(top, max(0, (int((end - begin).max()) // least_repeats).bit_length() - 1))
    suffixes = PrefixRanks(joined, top)
    tree = WaveletTree(suffixes.order, len(joined))
    runs = []
    for k, at in enumerate(blocks[: top + 1]):
        if not len(at):
            continue
        of = np.searchsorted(begin, at, "right") - 1
        block = at + shift[of]
        lo, hi = suffixes.range_of(k, block)
        upto = end[of] + shift[of]
        left = tree.count_below(lo, hi, np.minimum(block + (1 << k), upto))
        many = tree.count_below(lo, hi, np.minimum(block + (2 << k), upto)) - left
        met = many > 0
        block, lo, hi, left, many = block[met], lo[met], hi[met], left[met], many[met]
        if not len(block):
            continue
        one = tree.smallest(lo, hi, left)
        step = np.zeros(len(block), np.int64)
        several = many > 1
        step[several] = tree.smallest(lo[several], hi[several], left[several] + 1) - one[several]
        # Each term of a progression is a candidate.
        term = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        block, other = np.repeat(block, many), np.repeat(one, many) + term * np.repeat(step, many)
        period = other - block
        start = block - suffixes.common_before(block, other)
        stop = other + suffixes.common_after(block, other)
        good = stop - start >= np.maximum(least_words, least_repeats * period)
        runs.append(np.unique(np.stack([start[good], stop[good], period[good]], 1), axis=0))
    if not runs or not sum(map(len, runs)):
        return none
    found = np.concatenate(runs)
    # One stretch met with several periods has the least of them.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])
    start, stop, period = found[new].T
    back = shift[np.searchsorted(begin + shift, start, "right") - 1]
    start, stop = start - back, stop - back
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of all words, and where each text's words begin (one more at the end)."""
    inner = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= inner[1:] != inner[:-1]
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    held = inner[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(starts, offsets)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the kept words of each text, joined by single spaces."""
    # Per text: kept words, each with a space behind it but the last one.
    before = np.concatenate([[0], np.cumsum(kept)])
    s, e = starts[kept], ends[kept]
    of_last = before[bounds[1:]][before[bounds[1:]] > before[bounds[:-1]]] - 1
    room = e - s + 1
    room[of_last] -= 1
    out_ends = np.cumsum(room)
    total = int(out_ends[-1]) if len(room) else 0
    place = np.arange(total) + np.repeat(s - (out_ends - room), room)
    out = np.append(data, np.uint8(0))[place]
    spaces = np.ones(len(room), bool)
    spaces[of_last] = False
    out[out_ends[spaces] - 1] = ord(" ")
    return np.concatenate([[0], out_ends])[before[bounds]], out


def runs_of_slice(batch: pa.RecordBatch, least_words: int, least_repeats: int) -> pa.RecordBatch:
    """One slice (id, text) to rows (id, n_words, runs, collapsed)."""
    offsets, data = text_bytes(batch.column(1))
    starts, ends, bounds = words_of(offsets, data)
    symbols = hash_runs(data, starts, ends)
    start, stop, period = find_runs(symbols, bounds, least_words, least_repeats)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, stop, -1)
    kept = np.cumsum(edge)[:-1] == 0
    out_offsets, out = _joined(data, starts, ends, kept, bounds)
    text = np.searchsorted(bounds, start, "right") - 1
    in_text = pa.StructArray.from_arrays(
        [pa.array((start - bounds[text]).astype(np.int64)), pa.array((stop - start).astype(np.int64)), pa.array(period.astype(np.int64))],
        names=["start", "length", "period"],
    )
    rows = np.searchsorted(text, np.arange(batch.num_rows + 1))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(np.diff(bounds).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), in_text),
            pa.LargeStringArray.from_buffers(
                batch.num_rows, pa.py_buffer(out_offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))
            ).cast(pa.string()),
        ],
        names=["id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    least_words: int = LEAST_WORDS,
    least_repeats: int = LEAST_REPEATS,
) -> DataFrame:
    """One row per row: id, ``n_words``, ``runs`` (start, length, period in words, by start, then period), ``collapsed``.

    A run is a stretch of consecutive words with smallest period ``q`` and at least ``least_words`` words and
    ``least_repeats`` periods that no neighbouring word extends. ``collapsed`` are the words that no run holds after its
    first period, joined by single spaces. Words are runs of other bytes than ASCII white space, compared as they are. A
    null, empty or blank text has no words, no runs and an empty collapsed text; null ids stay; rows that repeat give equal
    rows; an empty table gives none; other columns are ignored. One pass without a shuffle; a task holds one slice of about
    2 MB, or one longer text.
    """
    if least_repeats < 4:
        raise ValueError("least_repeats must be 4 or more: blocks of a run with fewer periods may not recur in their window")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, 1, _BYTES):
                yield runs_of_slice(batch, least_words, least_repeats)

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = rows.mapInArrow(
        search, f"id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )
    return found.withColumnRenamed("id", id_col)
