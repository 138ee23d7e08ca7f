"""Best-fit packing by minimum bin slack.

Documents become token ids in Arrow batches; ids of a word never depend on its neighbours, so each worker encodes a
word once and finds it again by its hash. What has to be packed depends on lengths only: the lengths, at most ``limit``
different ones, are counted on the cluster and that histogram (at most ``limit`` rows at any corpus size) is packed on
the driver. A bin is opened for the longest length left; a bitset subset-sum over the lengths left finds the fullest
combination for the rest of the bin. The combination is removed as often as it is available, which is what solving for
each bin anew would give. The plan says which ranks of which length go where; pieces get their rank within their length
from range partitions, so that a length which very many pieces share spreads over the cluster.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, text_bytes
from leadloom.llm.common import keep, whole_text
from leadloom.operators.ranking import rank_within_key

LIMIT = 2048
#: Words whose ids a worker holds; beyond that it starts over.
CACHED_WORDS = 1_000_000
#: Bytes of text that are encoded at once (a longer text alone).
_BYTES = 4 << 20
_RANK_BITS = 44
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# Byte classes: where two bytes of unlike class meet, as said in ``WordIds.runs``, a token never spans both.
_SPACE, _LETTER, _MARK, _OTHER = range(4)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _OTHER, np.uint8)
    for byte in range(128):
        char = chr(byte)
        if char in "\t\n\x0b\x0c\r ":
            classes[byte] = _SPACE
        elif char.isalpha():
            classes[byte] = _LETTER
        elif char.isprintable() and not char.isdigit() and char != "'":
            classes[byte] = _MARK
    return classes


_CLASSES = _byte_classes()
_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


class WordIds:
    """Token ids of runs of characters, encoded once each and found again by a 64-bit multilinear hash."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.factors = np.zeros(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.start, self.size, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case, and start and end of each run that is encoded alone.

        The tokenizer drops white space, lowers letters and never joins a letter with an ASCII mark other than the
        apostrophe, so ASCII text can be cut there. Texts that hold a special token are cut at white space only.
        """
        low = _LOWER[data]
        classes = _CLASSES[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before, after = classes[:-1], classes[1:]
        inner = (before == _SPACE) != (after == _SPACE)
        raw = low.tobytes()
        if any(token in raw for token in _SPECIAL):
            low = data
        else:
            inner |= ((before == _LETTER) & (after == _MARK)) | ((before == _MARK) & (after == _LETTER))
        cut[1:-1] |= inner
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        inked = classes[starts] != _SPACE
        return low, starts[inked], ends[inked]

    def hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if len(size) and size.max() > len(self.factors):
            need = 1 << int(size.max()).bit_length()
            self.factors = np.random.default_rng(20240229).integers(1, 1 << 63, need, np.uint64) * np.uint64(2) + np.uint64(1)
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        value = (low[place + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * self.factors[place]
        return np.add.reduceat(value, first) if len(size) else np.zeros(0, np.uint64)

    def places(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, unique = pd.factorize(self.hashes(low, starts, ends))
        first = np.empty(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        keys = unique.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new and len(self.place) + len(new) > CACHED_WORDS:
            self.clear()
            new = range(len(keys))
        words = [low[starts[j] : ends[j]].tobytes().decode() for j in first[list(new)].tolist()]
        sizes, ids = [], []
        for at in range(0, len(words), 2000):
            chunk = words[at : at + 2000]
            encoded = self.tokenizer.encode(chunk, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(encoded.ids, np.int64))
            sizes.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(chunk)))
        if words:
            size = np.concatenate(sizes)
            base = len(self.ids)
            self.place.update(zip((keys[i] for i in new), range(len(self.size), len(self.size) + len(words))))
            self.start = np.concatenate([self.start, base + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, *ids])
        return np.fromiter((self.place[k] for k in keys), np.int64, len(keys))[codes]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids begin (one more at the end)."""
        offsets, data = text_bytes(texts)
        low, starts, ends = self.runs(data, offsets)
        place = self.places(low, starts, ends)
        size = self.size[place]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[place] - after[:-1], size) + np.arange(after[-1])]
        return ids, after[np.searchsorted(starts, offsets)]


_word_ids: dict[str, WordIds] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    coder = _word_ids[path]
    for whole in batches:
        for batch in by_size(whole, 1, _BYTES):
            ids, at = coder.encode(batch.column(1))
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.zeros(b - a + 1, "<u4")
                own[:-1] = ids[a:b]
                for piece, start in enumerate(range(0, len(own), limit)):
                    part = own[start : start + limit]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of at most ``limit`` ids (a document's ids, then id 0): doc_id, piece, start, length, ids_crc32.

    Only longer documents are cut; a null text is empty and gives one piece, the id 0.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return slim.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, limit), PIECES)


def fullest(lengths: list[int], counts: Mapping[int, int], room: int) -> list[int]:
    """Available lengths (descending, repeated as used) of the largest sum that fits: bitset subset-sum, read backwards.

    Bit s of a bitset says that sum s can be reached. Lengths are added in blocks of 1, 2, 4 … copies, so each
    multiplicity up to the available one can be reached.
    """
    full = (1 << (room + 1)) - 1
    reach, history = 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        block = 1
        while left > 0:
            take = min(block, left)
            history.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            block *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    used: list[int] = []
    for length, take, before in reversed(history):
        if not (before >> total) & 1:
            used += [length] * take
            total -= length * take
    return sorted(used, reverse=True)


def minimum_bin_slack(histogram: Mapping[int, int], capacity: int = LIMIT) -> list[tuple[list[int], int]]:
    """Bins as (lengths in one bin, how many such bins), for ``histogram``: length -> number of pieces."""
    counts = {k: int(v) for k, v in histogram.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    bins = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        rest = fullest([x for x in lengths if counts[x] and x <= capacity - first], counts, capacity - first)
        counts[first] += 1
        own = [first, *rest]
        need = {x: own.count(x) for x in set(own)}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        bins.append((own, times))
        lengths = [x for x in lengths if counts[x]]
    return bins


def placement(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For ranks of each length: key (length and first rank), first sequence, pieces a bin, offset of the first."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for own, times in bins:
        offset = 0
        for length in sorted(set(own), reverse=True):
            n = own.count(length)
            first = used.get(length, 0)
            rows.append((length << _RANK_BITS | first, sequence, n, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "sequence", "n", "offset"), table.T.copy()))


def _placed(batches: Iterator[pa.RecordBatch], plan: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        length, rank = np.asarray(columns["length"]), np.asarray(columns.pop("rank")) - 1
        key = length << _RANK_BITS | rank
        row = np.searchsorted(plan["key"], key, "right") - 1
        number = key - plan["key"][row]
        n = plan["n"][row]
        columns["sequence_id"] = pa.array(plan["sequence"][row] + number // n)
        columns["offset"] = pa.array(plan["offset"][row] + number % n * length)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: the columns of ``token_pieces``, ``sequence_id`` and ``offset`` (its place there, gapless from 0).

    Repeated rows are packed as often as they occur; a null id stays null. Empty input gives no rows. Columns other than
    doc_id and text are ignored.
    """
    pieces = keep(token_pieces(docs, tokenizer_path, limit), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = placement(minimum_bin_slack(histogram, limit))
    ranked = rank_within_key(pieces, ["length"], ["doc_id", "piece"], "rank")
    return ranked.mapInArrow(lambda batches: _placed(batches, plan), f"{PIECES}, sequence_id bigint, offset bigint")
