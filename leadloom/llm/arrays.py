"""Texts as byte arrays, and hashes of their parts, for code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``offsets`` (one more than texts, from 0) and the UTF-8 bytes of a string column without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], bytes_


_factors = np.zeros(0, np.uint64)


def _hash_values(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``hash_runs`` of runs of so many bytes that follow each other; ``value`` is each byte and one."""
    global _factors
    if not len(size):
        return np.zeros(0, np.uint64)
    if size.max() > len(_factors):
        need = max(1024, 1 << int(size.max()).bit_length())
        _factors = np.random.default_rng(20240229).integers(1, 1 << 63, need, np.uint64) * np.uint64(2) + np.uint64(1)
    first = np.cumsum(size) - size
    place = np.arange(len(value))
    place -= np.repeat(first, size)
    value *= _factors[place]
    return np.add.reduceat(value, first)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each run of bytes; the factors come from a fixed seed, so all workers agree."""
    size = ends - starts
    place = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
    return _hash_values(data[place].astype(np.uint64) + np.uint64(1), size)


def by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of a string column; a longer text comes alone."""
    offsets, _ = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


_INNER = np.array([True if i >= 128 else chr(i).isalnum() for i in range(256)])
_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)
_VALUES = _LOWER.astype(np.uint64) + np.uint64(1)


def _word_bounds(offsets: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.zeros(len(inner) + 1, bool)
    cut[1:-1] = inner[1:] != inner[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    words = inner[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[words], ends[words]
    return starts, ends, np.searchsorted(starts, offsets)


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_runs`` without the hashes."""
    offsets, data = text_bytes(texts)
    return _word_bounds(offsets, _INNER[data])


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts (runs of letters and digits, ASCII letters in lower case).

    Hashes, first and last byte (exclusive) of each word in the texts' joint bytes, and where each text's words begin (one
    more at the end).
    """
    offsets, data = text_bytes(texts)
    inner = _INNER[data]
    starts, ends, at = _word_bounds(offsets, inner)
    # The bytes of words, one word after the other, are all that are inside one.
    return _hash_values(_VALUES[data[inner]], ends - starts), starts, ends, at
