"""Fill-in-the-middle: texts cut at two unit ends, their parts put in another order between markers.

The UTF-8 bytes of an Arrow batch are viewed as uint64 words. Bytes that end a unit get their high bit set by plain
arithmetic on whole words (no byte loop); ``bitwise_count`` counts them per word, a search in the running counts finds
the word with the wanted end, and a multiplication spreads the counts of that word over its bytes to find the byte.
The words span all texts of a slice: the k-th end of a text is end number ``k + ends before the text`` of the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, text_bytes
from leadloom.llm.common import whole_text

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
PERCENT, SPM_PERCENT = 100, 50
UNITS = ("line", "char")
_BYTES = 2 << 20

_LOW = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_REST = np.uint64(0x7F7F7F7F7F7F7F7F)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian uint64 words, zeros behind the last one; one word at least lies beyond the data."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def mark_byte(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``, exactly: no carry runs from one byte into the next."""
    x = words ^ (_LOW * np.uint64(byte))
    return ~(((x & _REST) + _REST) | x | _REST)


def mark_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point: all but those of the form 10xxxxxx."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


def mark_char_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that a beginning of a code point follows."""
    starts = mark_starts(words)
    after = np.append(starts[1:], _HIGH)
    return (starts >> np.uint64(8)) | (after << np.uint64(56))


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of marked byte number ``k`` (from 0); it must exist."""
        word = np.searchsorted(self.before, k, "right") - 1
        wanted = (k - self.before[word] + 1).astype(np.uint64)
        # Byte i of the product holds the marks of bytes 0 to i; the bytes below ``wanted`` lie before the place.
        so_far = (self.marks[word] >> np.uint64(7)) * _LOW
        reached = ((so_far | _HIGH) - wanted * _LOW) & _HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def _holds_marker(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does a text hold one of the markers?"""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)])]
    text = np.searchsorted(offsets, at, "right") - 1
    return np.bincount(text[at + 3 <= offsets[text + 1]], minlength=len(offsets) - 1) > 0


def cut_slice(batch: pa.RecordBatch, unit: str, percent: int, spm_percent: int) -> pa.RecordBatch:
    """One slice (id, text, h1 to h4) to rows (id, n, form, prefix_chars, middle_chars, output)."""
    offsets, data = text_bytes(batch.column(1))
    h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
    first, last = offsets[:-1], offsets[1:]
    words = as_words(data)
    ends = Marks(mark_byte(words, ord("\n")) if unit == "line" else mark_char_ends(words))
    base = ends.rank(first)
    n = ends.rank(last) - base
    if unit == "line":
        # A last line without a line feed is a unit too.
        n += (last > first) & (data[np.maximum(last - 1, 0)] != ord("\n") if len(data) else False)

    def cut(units: np.ndarray) -> np.ndarray:
        place = np.where(units == 0, first, last)
        inner = (units > 0) & (units < n)
        place[inner] = ends.select((base + units - 1)[inner]) + 1
        return place

    a, b = h1 % (n + 1), h2 % (n + 1)
    one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    plain = (first == last) | _holds_marker(data, offsets) | (h3 % 100 >= percent)
    spm = h4 % 100 < spm_percent
    starts = Marks(mark_starts(words))
    before, upto = starts.rank(one), starts.rank(two)
    marker = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    raw = data.tobytes()
    parts = []
    for s, p, q, e, as_is, suffix_first in zip(first.tolist(), one.tolist(), two.tolist(), last.tolist(), plain.tolist(), spm.tolist()):
        if as_is:
            parts.append(raw[s:e])
        elif suffix_first:
            parts.append(b"".join((marker[1], raw[q:e], marker[0], raw[s:p], marker[2], raw[p:q])))
        else:
            parts.append(b"".join((marker[0], raw[s:p], marker[1], raw[q:e], marker[2], raw[p:q])))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(n.astype(np.int64)),
            pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
            pa.array((before - starts.rank(first)).astype(np.int64), mask=plain),
            pa.array((upto - before).astype(np.int64), mask=plain),
            pa.array(parts, pa.binary()).cast(pa.string()),
        ],
        names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _cut_batches(batches: Iterator[pa.RecordBatch], unit: str, percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, 1, _BYTES):
            yield cut_slice(batch, unit, percent, spm_percent)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    unit: str = "line",
    seed: int = SEED,
    percent: int = PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """One row per row: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` (the text put in order).

    Units are lines with their line feed, or code points (``unit="char"``). The first four groups of eight hex digits of
    sha256(``seed:id``) choose both cuts, whether the text is transformed (``percent`` of all texts) and whether the suffix
    comes first (``spm_percent`` of these). An empty text and one that holds a marker stay as they are: form ``plain``, null
    counts. A null text is empty, a null id counts as an empty string in the hash. Rows that repeat give equal rows; an empty
    table gives none; other columns are ignored. One pass without a shuffle; a task holds one slice of about 2 MB, or one
    longer text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *groups)
    cut = rows.mapInArrow(
        partial(_cut_batches, unit=unit, percent=percent, spm_percent=spm_percent),
        f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )
    return cut.withColumnRenamed("id", id_col)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``output`` was made of. Transformed texts hold no marker of their own, so each marker occurs once."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(out, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)
