"""Fuzzy repeated passages by collinear chaining.

Seeds are runs of ``SEED_WORDS`` words, sampled so that every run of ``SEED_WORDS + WINDOW - 1`` words has one (the
smallest hash of each window). Seeds that occur once drop out by a count. Each other occurrence is linked to the seed's
first one (smallest document, then place), so a passage in thousands of documents gives a link per document, not per
pair. So that a passage whose parts each occur earlier elsewhere has a source as a whole, each pair of seeds at most
``LATER`` seeds apart is linked to the first document that holds both, unless their own links tell the same. Where earlier
documents hold less of a passage than is listed, each run of ``LEAST_WORDS`` words with a seed first, in the middle or last
is linked to the first document that holds all of it. The links of two documents are chained in order: the best chain that
ends in a link adds it to the best chain that ends before it in both documents, less a cost for the gap, found by a Fenwick
tree of prefix maxima. Chains are aligned: words on one diagonal are compared directly, what lies between diagonals by a
banded alignment, and both ends grow, from one diagonal to the next, until the score has dropped too far. Stretches whose
share of aligned words is high enough are the passages: those of the best score, and longer ones that end in equal words.

Most pairs share one seed by chance. Each seed carries three bits of the words around it; where even these can't let the
seed grow beyond them, the words can't either, and as that would be too short for a passage the pair leaves before any
text is moved. Chains need no text, so both documents of a pair are cut to the surroundings of their chains before they
meet. A pair whose chains grow until they need a word that was cut off is found anew with its whole texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.arrays import by_size, text_bytes, word_bounds, word_runs
from leadloom.llm.common import keep, whole_text
from leadloom.llm.order_minhash import aligned

SEED_WORDS, WINDOW = 5, 16
LEAST_WORDS, SIMILARITY = 45, 0.8
#: A seed pairs with so many that follow it among its document's shared seeds; they reach a little beyond LEAST_WORDS.
LATER = 6
#: Cost of a word between two seeds of a chain, in either document.
GAP_COST = 0.1
#: A passage ends where this many more points are lost than its best end had (a word gained is one point).
DROP = 20.0
#: Words on each side of a seed of which it carries a code.
AROUND = 10
#: A seed with so many words more or less beside it may grow where so many of the codes agree.
SHIFTED, SHIFTED_EQUAL = 3, 5
#: Words on each side of a chain that go with it to where its documents meet.
SURROUNDINGS = 64
#: Occurrences of a seed that one task joins.
HOT = 2_000
_BYTES = 4 << 20
#: Seeds of which the pairs are made at once.
_SEEDS = 100_000
#: Words by which many ends grow side by side, round by round; words compared at once.
AT_ONCE, _CELLS = (32, 128, 512), 1 << 19
#: Words in both documents that a chain's end may pass over to go on where LOOK_EQUAL of the next LOOK words agree.
OVER = sorted(((i, j) for i in range(5) for j in range(5) if 0 < i + j <= 4), key=lambda o: (max(o), o))
LOOK, LOOK_EQUAL = 4, 2
#: Equal words at both ends of a passage that is longer than its best part.
END_WORDS = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: First and last word (exclusive) in a, in b, aligned words.
Block = tuple[int, int, int, int, int]
#: Where an end grew along a diagonal: words passed over in a and in b before that, and words grown.
Piece = tuple[int, int, int]


def _mixed(value: np.ndarray) -> np.ndarray:
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    return value


def seeds(words: np.ndarray, at: np.ndarray, coded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word number, hash, codes around; these 0 unless ``coded``) of the sampled seeds; of equal hashes in a
    window the leftmost counts."""
    none = np.zeros(0, np.int64)
    n = len(words) - SEED_WORDS + 1
    if n < 1:
        return none, none, none.astype(np.uint64), none
    value, spread = np.zeros(n, np.uint64), words ^ (words >> np.uint64(29))
    for i in range(SEED_WORDS):
        value *= _STEP
        value += spread[i : i + n]
    value = _mixed(value)
    low = np.uint64((1 << 26) - 1)
    key = (value & ~low) | np.arange(n, dtype=np.uint64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    # Windows end with their text; a text with fewer seeds than a window is one window.
    last = at[1:][doc] - SEED_WORDS
    inside = np.arange(n) <= last
    key = np.where(inside, key, np.uint64(2**64 - 1))
    least, done = key, 1
    padded = np.concatenate([key, np.full(WINDOW, np.uint64(2**64 - 1))])
    least = padded
    while done < WINDOW:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    starts = np.flatnonzero(inside & ((np.arange(n) + WINDOW - 1 <= last) | (np.arange(n) == at[:-1][doc])))
    # The least seed of a window never stands before that of the window before.
    place = (least[starts] & low).astype(np.int64)
    place = place[np.diff(place, prepend=-1) != 0]
    doc, value = doc[place], value[place]
    if not coded:
        return doc, place - at[doc], value, np.zeros(len(place), np.int64)
    # Three bits a word, 7 beyond the text; first the words before the seed, nearest first, then those after it.
    codes = (words % np.uint64(7)).astype(np.int64)
    around = np.zeros(len(place), np.int64)
    for k in range(AROUND):
        for shift, there in ((k, place - 1 - k), (AROUND + k, place + SEED_WORDS + k)):
            inside = (there >= at[doc]) & (there < at[doc + 1])
            around |= np.where(inside, codes[np.clip(there, 0, len(words) - 1)], 7) << (3 * shift)
    return doc, place - at[doc], value, around


def windows(words: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """For seeds at these places, a code of 21 bits of each of three runs of ``size`` words that hold the seed first, in the
    middle and last; 0 where the text has no such run."""
    factor = np.full(len(words) + 1, _STEP)
    factor[0] = 1
    back = np.full(len(words) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    back[0] = 1
    factor, back = np.multiply.accumulate(factor), np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words ^ (words >> np.uint64(29))) * factor[:-1])])
    out = np.zeros(len(place), np.int64)
    for k, before in enumerate((0, (size - SEED_WORDS) // 2, size - SEED_WORDS)):
        first = at[doc] + place - before
        inside = (first >= at[doc]) & (first + size <= at[doc + 1]) & (before >= 0)
        first = np.where(inside, first, 0)
        value = _mixed((total[np.where(inside, first + size, 0)] - total[first]) * back[first])
        code = 1 + (value >> np.uint64(32)).astype(np.int64) % ((1 << 21) - 1)
        out |= np.where(inside, code, 0) << (21 * k)
    return out


def _seed_rows(batches: Iterator[pa.RecordBatch], named: bool, size: int = LEAST_WORDS) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, whole.num_columns - 1, _BYTES // 8):
            words, _, _, at = word_runs(batch.column(batch.num_columns - 1))
            doc, place, value, around = seeds(words, at, named)
            columns = {"seed": pa.array(value.astype(np.int64))}
            if named:
                columns["doc_id"] = batch.column(0).take(pa.array(doc))
                columns["place"] = pa.array(place.astype(np.int32))
                columns["around"] = pa.array(around)
                columns["windows"] = pa.array(windows(words, at, doc, place, size))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of links (numbers into ``x`` and ``y``, places in the two documents), best first, each link in one.

    f(i) = SEED_WORDS + max(0, f(j) - GAP_COST * (x_i - x_j + y_i - y_j)) over all j before i in both documents. The cost
    is a difference of sums, so the Fenwick tree holds f(j) + GAP_COST * (x_j + y_j) by the rank of y_j.
    """
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    rank = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    best: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(rank) + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    waiting: list[int] = []
    for i in order:
        if waiting and x[waiting[0]] < x[i]:
            for j in waiting:
                value, r = (score[j] + GAP_COST * (x[j] + y[j]), j), rank[y[j]]
                while r < len(best):
                    if best[r] < value:
                        best[r] = value
                    r += r & -r
            waiting = []
        found, r = (float("-inf"), -1), rank[y[i]] - 1
        while r:
            if best[r] > found:
                found = best[r]
            r -= r & -r
        gain = found[0] - GAP_COST * (x[i] + y[i])
        score[i] = SEED_WORDS + max(0.0, gain)
        before[i] = found[1] if gain > 0 else -1
        waiting.append(i)
    used = [False] * len(x)
    out = []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], x[i], y[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _grow(a: np.ndarray, b: np.ndarray, penalty: float, ended: list[bool] | None = None, scores: list[float] | None = None) -> int:
    """Words by which two aligned ends may grow: up to the best score before it drops too far. ``ended`` gets whether it did
    drop so far within these words, ``scores`` the best score."""
    n, best, best_at, score, at = min(len(a), len(b)), 0.0, 0, 0.0, 0
    a, b = a[:n], b[:n]
    stop = np.zeros(0, np.int64)
    while at < n and not len(stop):
        equal = a[at : at + 512] == b[at : at + 512]
        run = score + np.cumsum(np.where(equal, 1.0, -penalty))
        peak = np.maximum(np.maximum.accumulate(run), best)
        stop = np.flatnonzero(peak - run > DROP)
        run = run[: stop[0] + 1] if len(stop) else run
        top = int(np.argmax(run))
        if run[top] > best:
            best, best_at = float(run[top]), at + top + 1
        score, at = float(run[-1]), at + 512
    if ended is not None:
        ended.append(len(stop) > 0)
    if scores is not None:
        scores.append(best)
    return best_at


def _grown(
    a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray, room: np.ndarray, penalty: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grown``, also the best scores."""
    out, ended, score = np.zeros(len(i), np.int64), np.zeros(len(i), bool), np.zeros(len(i))
    left = np.arange(len(i))
    for steps in AT_ONCE:
        k, most = np.arange(steps), _CELLS // steps
        for own in (left[at : at + most] for at in range(0, len(left), most)):
            inside = k < room[own, None]
            shift = np.where(inside, step[own, None] * k, 0)
            equal = a.take(i[own, None] + shift, mode="clip") == b.take(j[own, None] + shift, mode="clip")
            run = np.cumsum(np.where(inside, np.where(equal, 1.0, -penalty), 0.0), axis=1)
            low = np.maximum(np.maximum.accumulate(run, axis=1), 0.0) - run > DROP
            ended[own] = low.any(axis=1)
            run[k > np.where(ended[own], low.argmax(axis=1), steps)[:, None]] = -np.inf
            top = run.argmax(axis=1)
            best = run[np.arange(len(top)), top]
            out[own], score[own] = np.where(best > 0, top + 1, 0), np.maximum(best, 0.0)
        left = left[~ended[left] & (room[left] > steps)]
    for e in left.tolist():
        ahead = slice(0, int(room[e]))
        here, there = (w[p:] if step[e] > 0 else w[: p + 1][::-1] for w, p in ((a, int(i[e])), (b, int(j[e]))))
        found: list[bool] = []
        scores: list[float] = []
        out[e], ended[e] = _grow(here[ahead], there[ahead], penalty, found, scores), found[0]
        score[e] = scores[0]
    return out, ended, score


def grown(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray, room: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """``_grow`` of many ends, and whether they ended: end e compares the words a[i + k * step] and b[j + k * step], k < room.

    Most are chance and end within a few words. They take their first steps side by side, what has not ended then takes
    more steps, and only the longest go on alone.
    """
    return _grown(a, b, i, j, step, room, penalty)[:2]


def grown_across(
    a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray, known: tuple[np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray], penalty: float
) -> tuple[list[list[Piece]], np.ndarray, np.ndarray]:
    """Ends that grow along their diagonal, then pass over some words (``OVER``) to where they gain most, and so on until the
    score has dropped too far.

    ``known`` and ``there`` are the words of a and b beyond each end, those at hand and all. Returns the pieces of each end,
    the words in a that they take, and whether more words than are at hand might change this.
    """
    i, j, known, there = i.copy(), j.copy(), tuple(k.copy() for k in known), tuple(t.copy() for t in there)
    room, full = np.minimum(*known), np.minimum(*there)
    by, ended, _ = _grown(a, b, i, j, step, room, penalty)
    #: Points that each end is below its best.
    lost = np.zeros(len(i))
    pieces, taken, unsure = [[(0, 0, g)] for g in by.tolist()], by.copy(), ~ended & (room < full)

    def move(e: np.ndarray, over: np.ndarray, by: np.ndarray) -> None:
        for place, own, all_, skip in zip((i, j), known, there, over):
            place[e] += step[e] * (skip + by)
            own[e] -= skip + by
            all_[e] -= skip + by

    left = np.arange(len(i))
    move(left, np.zeros((2, len(i)), np.int64), by)
    over_all = np.array(OVER)
    ahead = np.arange(LOOK + over_all.max())
    # Nothing is left to gain at the end of a text.
    while len(left := left[np.minimum(there[0][left], there[1][left]) > 0]):
        room, full = (np.minimum(*(w[left, None] - over_all[:, o] for o, w in enumerate(words))) for words in (known, there))
        unsure[left] |= ((room < LOOK) & (room < full)).any(axis=1)
        near_a, near_b = (
            w.take(place[left, None] + np.where(ahead < own[left, None], step[left, None] * ahead, 0), mode="clip")
            for w, place, own in ((a, i, known[0]), (b, j, known[1]))
        )
        agree = np.empty(room.shape, bool)
        for o, (over_a, over_b) in enumerate(OVER):
            equal = near_a[:, over_a : over_a + LOOK] == near_b[:, over_b : over_b + LOOK]
            agree[:, o] = (equal & (ahead[:LOOK] < room[:, o, None])).sum(axis=1) >= LOOK_EQUAL
        own, which = np.nonzero(agree)
        e, over = left[own], over_all[which]
        by, ended, score = _grown(a, b, i[e] + step[e] * over[:, 0], j[e] + step[e] * over[:, 1], step[e], room[own, which], penalty)
        np.logical_or.at(unsure, e, ~ended & (room[own, which] < full[own, which]))
        gain = np.where(by > 0, score - penalty * over.max(axis=1, initial=0), -np.inf)
        order = np.lexsort((which, -gain, own))
        order = order[np.diff(own[order], prepend=-1) != 0]
        left, best, over, by = e[order], gain[order], over[order].T, by[order]
        lost[left] = np.maximum(lost[left] - best, 0)
        near = lost[left] <= DROP
        left, over, by = left[near], over[:, near], by[near]
        for e, *piece in zip(left.tolist(), over[0].tolist(), over[1].tolist(), by.tolist()):
            pieces[e].append(tuple(piece))
        taken[left] += over[0] + by
        move(left, over, by)
    return pieces, taken, unsure


def _aligned(left: list[int], right: list[int]) -> int:
    return aligned(left, right, abs(len(left) - len(right)) + 16) if left and right else 0


def _between(left: list[int], right: list[int], x: int, y: int, penalty: float) -> list[Block]:
    """The blocks of words (at x and y) that are on no common diagonal: one, unless the score would drop too far in it and
    half is aligned; then equal runs of two words and more are blocks of their own, so that scattered differences count one
    by one."""
    same, longer = _aligned(left, right), max(len(left), len(right))
    if penalty * (longer - same) <= DROP or same < longer / 2:
        return [(x, x + len(left), y, y + len(right), same)]
    places = defaultdict(list)
    for q in range(len(right) - 1):
        places[right[q], right[q + 1]].append(q)
    width = abs(len(left) - len(right)) + 16
    links = []
    for p in range(len(left) - 1):
        near = places.get((left[p], left[p + 1]), [])
        links += [(p, q) for q in near[bisect_left(near, p - width) : bisect_right(near, p + width)]]
    best = chains(*zip(*links))[0] if links else []
    out: list[Block] = []
    i = j = 0
    for p, q in [*(links[k] for k in best), (len(left), len(right))]:
        end = min(p + 2, len(left))
        if out and p < i and i - p == j - q and out[-1][4] == out[-1][1] - out[-1][0]:
            p, q = i, j
        if p < i or q < j:
            continue
        if p > i or q > j:
            out.append((x + i, x + p, y + j, y + q, _aligned(left[i:p], right[j:q])))
        if end > p:
            begin, begin_y, n = x + p, y + q, end - p
            if out and out[-1][4] == out[-1][1] - out[-1][0] == out[-1][3] - out[-1][2] and out[-1][1] == begin:
                begin, begin_y, *_ = out.pop()[::2]
                n = x + end - begin
            out.append((begin, begin + n, begin_y, begin_y + n, n))
        i, j = end, q + end - p
    return out


def _blocks(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], before: list[Piece], after: list[Piece], penalty: float) -> list[Block]:
    """A chain that grows by these pieces before and after it as blocks, which follow each other in both."""
    runs = [[x[0], x[0] + SEED_WORDS, y[0] - x[0]]]
    for i, j in zip(x[1:], y[1:]):
        if j - i == runs[-1][2]:
            runs[-1][1] = max(runs[-1][1], i + SEED_WORDS)
        else:
            runs.append([i, i + SEED_WORDS, j - i])
    for over_a, over_b, by in before:
        if over_a == over_b == 0:
            runs[0][0] -= by
        else:
            end = runs[0][0] - over_a
            runs.insert(0, [end - by, end, runs[0][2] + over_a - over_b])
    for over_a, over_b, by in after:
        if over_a == over_b == 0:
            runs[-1][1] += by
        else:
            begin = runs[-1][1] + over_a
            runs.append([begin, begin + by, runs[-1][2] + over_b - over_a])
    out: list[Block] = []
    end_x = end_y = -1
    for begin, end, shift in runs:
        if out:
            # Overlapping diagonals: the later run begins where the earlier one ended in both.
            begin = max(begin, end_x, end_y - shift)
            if begin >= end:
                continue
            left, right = a[end_x:begin], b[end_y : begin + shift]
            if len(left) or len(right):
                out += _between(left.tolist(), right.tolist(), end_x, end_y, penalty)
        equal = a[begin:end] == b[begin + shift : end + shift]
        edges = [0, *(np.flatnonzero(equal[1:] != equal[:-1]) + 1).tolist(), len(equal)]
        for i, j in zip(edges, edges[1:]):
            x, y = slice(begin + i, begin + j), slice(begin + i + shift, begin + j + shift)
            if equal[i] or j - i < 3:
                out.append((x.start, x.stop, y.start, y.stop, (j - i) if equal[i] else 0))
            else:
                # A word more in one document and a word less further on leave the diagonal and come back to it.
                out += _between(a[x].tolist(), b[y].tolist(), x.start, y.start, penalty)
        end_x, end_y = end, end + shift
    return out


def stretches(blocks: list[Block], least_words: int, least: float) -> list[Block]:
    """(first and last word in a, in b, aligned words) of the similar stretches of a chain's blocks."""
    penalty = least / (1 - least)
    found = []
    begin, best, best_end, score = 0, 0.0, -1, 0.0
    i = 0
    while i <= len(blocks):
        ended = i == len(blocks)
        if not ended:
            block = blocks[i]
            score += block[4] - penalty * (max(block[1] - block[0], block[3] - block[2]) - block[4])
            if score > best:
                best, best_end = score, i
        if ended or score <= 0 or best - score > DROP:
            if best_end >= begin:
                own = blocks[begin : best_end + 1]
                size = max(own[-1][1] - own[0][0], own[-1][3] - own[0][2])
                same = sum(o[4] for o in own)
                if own[-1][1] - own[0][0] >= least_words and same >= least * size:
                    found.append((own[0][0], own[-1][1], own[0][2], own[-1][3], same))
                # What was lost after the best end may begin another passage.
                i = best_end
            begin, best, best_end, score = i + 1, 0.0, -1, 0.0
        i += 1
    return found


def longest(blocks: list[Block], least_words: int, least: float) -> list[Block]:
    """The longest similar stretches of a chain's blocks, as of ``stretches``, which are those of the best score.

    The best score prefers a short part with few differences to all of a passage with more. So that chance words do not
    make a passage longer, it begins and ends with ``END_WORDS`` equal words, and a difference by which the score drops too
    far is in none.
    """
    out, penalty = [], least / (1 - least)
    far = [o for o, block in enumerate(blocks) if penalty * (max(block[1] - block[0], block[3] - block[2]) - block[4]) > DROP]
    parts = [(i + 1, j) for i, j in zip([-1, *far], [*far, len(blocks)])]
    while parts:
        begin, end = parts.pop()
        ends = np.array([o for o in range(begin, end) if blocks[o][4] == blocks[o][1] - blocks[o][0] >= END_WORDS], np.int64)
        if not len(ends) or blocks[ends[-1]][1] - blocks[ends[0]][0] < least_words:
            continue
        first_a, last_a, first_b, last_b, same = np.array(blocks[begin:end], np.int64).T
        done, best, ends = np.concatenate([[0], np.cumsum(same)]), (0, 0, 0), ends - begin
        for k, i in enumerate(ends.tolist()):
            j = ends[k:]
            n_a, n_same = last_a[j] - first_a[i], done[j + 1] - done[i]
            if n_a[-1] < max(least_words, best[0]):
                break
            fits = np.flatnonzero((n_a >= least_words) & (n_same >= least * np.maximum(n_a, last_b[j] - first_b[i])))
            if len(fits):
                best = max(best, (int(n_a[fits[-1]]), -i, int(j[fits[-1]])))
        if best[0]:
            i, j = -best[1], best[2]
            out.append((int(first_a[i]), int(last_a[j]), int(first_b[i]), int(last_b[j]), int(done[j + 1] - done[i])))
            parts += [(begin, begin + i), (begin + j + 1, end)]
    return out


def apart(found: list[Block]) -> list[Block]:
    """The passages of two documents without those half of which lies in a better one, in both."""
    inside = lambda own, o, k: 2 * (min(own[k + 1], o[k + 1]) - max(own[k], o[k])) >= own[k + 1] - own[k]
    out: list[Block] = []
    for own in sorted(sorted(found), key=lambda f: -f[4]):
        if not any(inside(own, o, 0) and inside(own, o, 2) for o in out):
            out.append(own)
    return sorted(out)


def stuck(a: Column, b: Column, least: float) -> Column:
    """Whether two equal seeds with the codes ``a`` and ``b`` around can't grow beyond these words on either side: neither on
    their diagonal nor, after up to ``SHIFTED`` words more in one document, on one on which ``SHIFTED_EQUAL`` words agree.

    Equal words have equal codes, so a growth by codes ends no earlier than that by words.
    """
    penalty = least / (1 - least)

    def side(first: int) -> Column:
        start = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("best"), F.lit(False).alias("ended"))

        def step(acc: Column, k: Column) -> Column:
            own, other = (F.call_function("shiftright", c, 3 * k).bitwiseAND(F.lit(7)) for c in (a, b))
            score = acc["score"] + F.when((own == other) & (own != 7), 1.0).otherwise(-penalty)
            best = F.greatest(acc["best"], score)
            outside = (own == 7) | (other == 7)
            return F.struct(score.alias("score"), best.alias("best"), (acc["ended"] | outside | (best - score > DROP)).alias("ended"))

        return F.aggregate(F.sequence(F.lit(first), F.lit(first + AROUND - 1)), start, step, lambda acc: acc["ended"])

    def apart(first: int) -> Column:
        right = lambda c, n: F.call_function("shiftright", c, F.lit(n))
        own, other = (right(c, 3 * first).bitwiseAND(F.lit((1 << 3 * AROUND) - 1)) for c in (a, b))
        out = F.lit(True)
        for over in range(1, SHIFTED + 1):
            n = AROUND - over
            for x, y in ((own, other), (other, own)):
                differ = right(x, 3 * over).bitwiseXOR(y)
                differ = differ.bitwiseOR(right(differ, 1)).bitwiseOR(right(differ, 2))
                outside = y.bitwiseAND(right(y, 1)).bitwiseAND(right(y, 2))
                count = F.bit_count(differ.bitwiseOR(outside).bitwiseAND(F.lit(sum(1 << 3 * k for k in range(n)))))
                out &= count > n - SHIFTED_EQUAL
        return out

    return side(0) & side(AROUND) & apart(0) & apart(AROUND)


_PASSAGE = (
    "doc_id bigint, source_id bigint, first_word bigint, last_word bigint, source_first bigint, source_last bigint, "
    "n_aligned bigint, start bigint, end bigint, chains array<array<bigint>>"
)


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains, as lists of links, of rows (doc_id, source_id, links, links of runs of words). The latter may name another
    place of the same seed, so they are chained apart."""
    for batch in batches:
        chained = []
        for links, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own = []
            for part in (links, sorted(set(runs) - set(links))):
                found = chains([link >> 32 for link in part], [link & 0xFFFFFFFF for link in part])
                own += [[part[i] for i in chain] for chain in found]
            chained.append(own)
        columns = [batch.column(0), batch.column(1), pa.array(chained, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source_id", "chains"])


def _spans(chained: list[list[int]], is_source: bool, n: int, around: int) -> list[tuple[int, int]]:
    """First and last word (exclusive) of the surroundings of these chains in a document of n words, apart and in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(((c[0] & 0xFFFFFFFF, c[-1] & 0xFFFFFFFF) if is_source else (c[0] >> 32, c[-1] >> 32)) for c in chained):
        begin, end = max(0, first - around), min(n, last + SEED_WORDS + around)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        elif begin < end:
            out.append((begin, end))
    return out


_CUT = "doc_id bigint, source_id bigint, is_source boolean, chains array<array<bigint>>, n int, first array<int>, point array<bigint>, part array<string>"


def _cut_rows(batches: Iterator[pa.RecordBatch], around: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, source_id, is_source, chains, text) with the parts of the text around the chains (None: all of it)
    instead of the text: number of all words, and each part's first word, code points before it and text."""
    names = [part.split(" ")[0] for part in _CUT.split(", ")]
    for whole in batches:
        for batch in by_size(whole, 4, _BYTES):
            text = batch.column(4)
            # The rows of one document mostly follow each other; its text is cut into words once.
            new = np.ones(len(text), bool)
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
            text = text.filter(pa.array(new))
            starts, ends, at = word_bounds(text)
            offsets, data = text_bytes(text)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            sizes, firsts, befores, parts = [], [], [], []
            for i, is_source, chained in zip((np.cumsum(new) - 1).tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                base, n = at[i], int(at[i + 1] - at[i])
                spans = _spans(chained, is_source, n, n if around is None else around)
                sizes.append(n)
                firsts.append([begin for begin, _ in spans])
                befores.append([int(points[starts[base + begin]] - points[offsets[i]]) for begin, _ in spans])
                parts.append([data[starts[base + begin] : ends[base + end - 1]].tobytes().decode() for begin, end in spans])
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))
            columns = [*(batch.column(c) for c in range(4)), *(pa.array(c, k) for c, k in zip((sizes, firsts, befores, parts), kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


class _Side:
    """One document of each pair of a batch, from the four columns that start with this one: the words of all parts in a
    row with their first and last (exclusive) code points, and of each part its pair, first word and place in that row."""

    def __init__(self, batch: pa.RecordBatch, column: int) -> None:
        parts = batch.column(column + 3)
        text = parts.flatten()
        self.n = batch.column(column).to_numpy().astype(np.int64)
        words, starts, ends, at = word_runs(text)
        # A spare word, as texts may be without any.
        self.words = np.append(words, np.uint64(0))
        offsets, data = text_bytes(text)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        shift = np.repeat(batch.column(column + 2).flatten().to_numpy() - points[offsets[:-1]], np.diff(at))
        self.begin, self.end = points[starts] + shift, points[ends] + shift
        # An empty part before all others, for chains that no part holds.
        self.pair = np.concatenate([[-1], np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())])
        self.first = np.concatenate([[0], batch.column(column + 1).flatten().to_numpy().astype(np.int64)])
        self.at = np.concatenate([[0], at])

    def holds(self, pair: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of chains with these first and last seeds: whether a part holds them, what to add to a word's number for its place
        in the row, words known before and after the chain, and words that the document has there."""
        part = np.searchsorted(self.pair << 32 | self.first, pair << 32 | first, "right") - 1
        shift = self.at[part] - self.first[part]
        known = first - self.first[part], self.at[part + 1] - (last + SEED_WORDS + shift)
        return (self.pair[part] == pair) & (known[1] >= 0), shift, *known, first, self.n[pair] - (last + SEED_WORDS)


def _passage_rows(batches: Iterator[pa.RecordBatch], least_words: int, least: float) -> Iterator[pa.RecordBatch]:
    """For rows (doc_id, source_id, chains, and for document and source n, first, point, part). A pair that needs more of
    its texts gives its chains instead of passages.

    All chains of a batch grow at once; those that stay shorter than a passage, nearly all, end here.
    """
    names = [part.split(" ")[0] for part in _PASSAGE.split(", ")]
    kinds = [pa.int64()] * (len(names) - 1) + [pa.list_(pa.list_(pa.int64()))]
    penalty = least / (1 - least)
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            batch = whole.slice(start, 64)
            a, b = _Side(batch, 3), _Side(batch, 7)
            chained = batch.column(2).flatten()
            pair = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            links = chained.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(chained.value_lengths().to_numpy())])
            x, y = links >> 32, links & 0xFFFFFFFF
            first, last = at[:-1], at[1:] - 1
            in_a, to_a, *around_a = a.holds(pair, x[first], x[last])
            in_b, to_b, *around_b = b.holds(pair, y[first], y[last])
            held = in_a & in_b
            # Each chain's end before it, then after it; without words where no part holds the chain.
            known, there = ([np.where(np.tile(held, 2), np.concatenate([s[k], s[k + 1]]), 0) for s in (around_a, around_b)] for k in (0, 2))
            i, j = (np.concatenate([p[first] + to - 1, p[last] + to + SEED_WORDS]) for p, to in ((x, to_a), (y, to_b)))
            pieces, by, unsure = grown_across(a.words, b.words, i, j, np.repeat([-1, 1], len(pair)), known, there, penalty)
            cut_off = np.unique(np.concatenate([pair, pair])[unsure])
            n = len(pair)
            long = held & (x[last] + SEED_WORDS - x[first] + by[:n] + by[n:] >= least_words) & ~np.isin(pair, cut_off)
            found: dict[int, list[Block]] = {}
            equal_runs: dict[int, dict[int, list[tuple[int, int]]]] = {}
            size = x[last] - x[first] + by[:n] + by[n:]
            for c in sorted(np.flatnonzero(long).tolist(), key=lambda c: -size[c]):
                own, s, t = slice(at[c], at[c + 1]), int(to_a[c]), int(to_b[c])
                # A chain that lies where an earlier one grew grows alike, one inside a passage not shorter adds nothing.
                link = [(int(x[l]) + s, int(y[l]) + t - int(x[l]) - s) for l in (first[c], last[c])]
                runs = equal_runs.setdefault(int(pair[c]), defaultdict(list))
                if all(any(begin <= at_ and at_ + SEED_WORDS <= end for begin, end in runs[shift]) for at_, shift in link):
                    continue
                (x_0, shift_0), (x_1, shift_1), before, after = *link, pieces[c], pieces[n + c]
                a_0, a_1 = x_0 - s - int(by[c]), x_1 - s + SEED_WORDS + int(by[n + c])
                b_0, b_1 = x_0 + shift_0 - t - sum(p[1] + p[2] for p in before), x_1 + shift_1 - t + SEED_WORDS + sum(p[1] + p[2] for p in after)
                if any(f[0] <= a_0 and a_1 <= f[1] and f[2] <= b_0 and b_1 <= f[3] and f[4] >= a_1 - a_0 for f in found.get(int(pair[c]), [])):
                    continue
                blocks = _blocks(a.words, b.words, (x[own] + s).tolist(), (y[own] + t).tolist(), before, after, penalty)
                for block in blocks:
                    if block[4] == block[1] - block[0] >= SEED_WORDS:
                        runs[block[2] - block[0]].append(block[:2])
                passages = stretches(blocks, least_words, least)
                rest = sum(block[4] for block in blocks) - sum(p[4] for p in passages)
                for p in longest(blocks, least_words, least) if rest >= (END_WORDS if passages else least * least_words) else []:
                    rest = [q for q in passages if q[0] < p[0] or q[1] > p[1]]
                    if all(q[1] <= p[0] or q[0] >= p[1] for q in rest):
                        passages = [*rest, p]
                for p in passages:
                    points = int(a.begin[p[0]]), int(a.end[p[1] - 1])
                    found.setdefault(int(pair[c]), []).append((p[0] - s, p[1] - s, p[2] - t, p[3] - t, p[4], *points))
            ids = [(d, s) for d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(*ids[k], *[None] * 7, batch.column(2)[k].as_py()) for k in cut_off.tolist()]
            rows += [(*ids[k], *p, None) for k in found for p in apart(found[k])]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _passages_of(links: DataFrame, rows: DataFrame, around: int | None, least_words: int, least: float) -> DataFrame:
    """Passages of pairs (doc_id, source_id, chains) whose texts, in ``rows``, are cut to the chains' surroundings."""
    ends = F.transform("chains", lambda c: F.array(c[0], F.element_at(c, -1)))
    sides = links.select(F.col("doc_id").alias("id"), "doc_id", "source_id", F.lit(False).alias("is_source"), "chains").unionByName(
        links.select(F.col("source_id").alias("id"), "doc_id", "source_id", F.lit(True).alias("is_source"), ends.alias("chains"))
    )
    texts = rows.select(F.col("doc_id").alias("id"), "text")
    cut = sides.join(texts, "id").select("doc_id", "source_id", "is_source", "chains", "text").mapInArrow(lambda b: _cut_rows(b, around), _CUT)
    side = F.struct("n", "first", "point", "part")
    met = cut.groupBy("doc_id", "source_id").agg(
        F.any_value(F.when(~F.col("is_source"), F.col("chains")), True).alias("chains"),
        F.collect_set(F.when(~F.col("is_source"), side)).alias("docs"),
        F.collect_set(F.when(F.col("is_source"), side)).alias("sources"),
    )
    met = met.withColumn("doc", F.explode("docs")).withColumn("source", F.explode("sources"))
    met = met.select("doc_id", "source_id", "chains", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("doc", "source") for c in ("n", "first", "point", "part")])
    return met.mapInArrow(lambda b: _passage_rows(b, least_words, least), _PASSAGE)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near seeds with all their places, for rows (doc_id, the seeds as structs (place, seed, source_id, at) in
    order); without those that the seeds' own links tell."""
    for whole in batches:
        ends = np.cumsum(whole.column(1).value_lengths().to_numpy())
        first = 0
        while first < whole.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + _SEEDS, "right")))
            batch = whole.slice(first, last - first)
            first = last
            place, seed, source, at = (c.to_numpy() for c in batch.column(1).flatten().flatten())
            doc = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            left, right = [], []
            for k in range(1, LATER + 1):
                x, y = slice(0, max(0, len(doc) - k)), slice(k, None)
                told = (source[x] == source[y]) & (np.abs(at[y] - at[x] - place[y] + place[x]) <= WINDOW)
                left.append(np.flatnonzero((doc[x] == doc[y]) & ~told))
                right.append(left[-1] + k)
            x, y = np.concatenate(left), np.concatenate(right)
            pair = _mixed(seed[x].view(np.uint64) * _STEP + seed[y].view(np.uint64)).view(np.int64)
            order = np.lexsort((place[y], place[x], pair, doc[x]))
            x, y, pair = x[order], y[order], pair[order]
            new = np.flatnonzero((np.diff(pair, prepend=0) != 0) | (np.diff(doc[x], prepend=-1) != 0))
            both = pa.StructArray.from_arrays([pa.array(place[x]), pa.array(place[y])], names=["p", "q"])
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(x)]]).astype(np.int32)), both)
            columns = [batch.column(0).take(pa.array(doc[x[new]])), pa.array(pair[new]), places]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pair", "places"])


def _pair_links(known: DataFrame) -> DataFrame:
    """``doc_id, source_id, link`` of the seed pairs that occur in several documents, for rows (seed, doc_id, place) with
    the first document and place of the seed (source_id, at).

    Where both seeds stand first in one document and as far apart there, their own links name it already; such a pair is
    left out. The rest is one row per document and pair, with all its places; a pair of one document drops out by minima
    that are combined before they travel, so only pairs of several documents are joined to their first one.
    """
    listed = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "seed", "source_id", "at"))).alias("own"))
    pairs = listed.mapInArrow(_pair_rows, "doc_id bigint, pair bigint, places array<struct<p:int,q:int>>")
    pairs = keep(pairs, "seed-pairs")
    first = pairs.groupBy("pair").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last")).where("source_id < last")
    first = keep(first.select("pair", "source_id"), "shared-pairs")
    sources = pairs.join(first.withColumnRenamed("source_id", "doc_id"), ["pair", "doc_id"])
    sources = keep(sources.select("pair", F.col("doc_id").alias("source_id"), F.col("places")[0].alias("first")), "first-pairs")
    met = pairs.join(sources, "pair").where("doc_id <> source_id")
    link = lambda x, c: F.shiftleft(x[c].cast("bigint"), 32).bitwiseOR(F.col(f"first.{c}").cast("bigint"))
    links = F.flatten(F.transform("places", lambda x: F.array(link(x, "p"), link(x, "q"))))
    return met.select("doc_id", "source_id", F.explode(F.array_distinct(links)).alias("link"))


def _window_links(known: DataFrame) -> DataFrame:
    """``doc_id, source_id, run`` (a link) of each run of words around a seed (``windows``) that several documents hold and the seed's
    first document (with the runs ``told``) does not, to the first one that does.

    So a passage has a source that holds enough of it, whichever documents hold less of it before.
    """
    code = lambda c, k: F.call_function("shiftright", F.col(c), F.lit(21 * k)).bitwiseAND(F.lit((1 << 21) - 1))
    new = lambda k: (code("windows", k) != 0) & (code("windows", k) != code("told", k))
    runs = F.array_compact(F.array(*[F.when(new(k), F.xxhash64("seed", F.lit(k), code("windows", k))) for k in range(3)]))
    rows = known.select(F.explode(runs).alias("seed"), "doc_id", "place")
    first = rows.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = first.where("first.doc_id < last").select("seed", F.col("first.doc_id").alias("source_id"), F.col("first.place").alias("at"), "n")
    met = _with_seeds(rows, keep(first, "first-windows")).where("doc_id <> source_id")
    return met.select("doc_id", "source_id", _link("place", "at").alias("run"))


def _link(place: str, at: str) -> Column:
    return F.shiftleft(F.col(place).cast("bigint"), 32).bitwiseOR(F.col(at).cast("bigint"))


def _with_seeds(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """``rows`` (seed, doc_id, place and more) joined to their row in ``seeds`` (seed, n and more; a table in the shared
    folder), without n.

    The rows of a seed that occurs more than ``HOT`` times are dealt over as many tasks as that makes full, each with a copy
    of the seed's row. Such seeds are few: at most one in ``HOT`` rows.
    """
    tasks = F.ceil(F.col("n") / HOT).cast("int")
    hot = seeds.where(F.col("n") > HOT).select("seed", tasks.alias("tasks"))
    task = F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), F.col("tasks")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), "seed", "left").withColumn("task", task).drop("tasks")
    copies = seeds.withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt.join(copies, ["seed", "task"]).drop("task", "n")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> DataFrame:
    """Passages that recur across documents: doc_id, first_word, last_word (exclusive), start, end (code points), source_id
    with source_first and source_last (words), n_aligned, similarity.

    The source is the smallest document that shares a seed, or a pair of seeds, of the passage; it is listed as such, its own rows name sources
    with smaller ids only. A document can have several passages, also overlapping ones of unlike sources. Words are runs of
    letters and digits, ASCII case aside. A null text is empty; rows without an id take no part; rows that repeat an id
    count as one, ids are taken to name one text each. Passages within one document aren't listed. Empty input gives no
    rows; other columns are ignored.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    counted = rows.select("text").mapInArrow(lambda b: _seed_rows(b, False), "seed bigint")
    shared = keep(counted.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "shared-seeds")
    named = rows.mapInArrow(
        lambda b: _seed_rows(b, True, least_words), "seed bigint, doc_id bigint, place int, around bigint, windows bigint"
    )
    held = keep(_with_seeds(named, shared), "seeds")
    first = held.groupBy("seed").agg(F.min(F.struct("doc_id", "place", "around", "windows")).alias("first"), F.count("*").alias("n"))
    first = first.select(
        "seed", F.col("first.doc_id").alias("source_id"), F.col("first.place").alias("at"), F.col("first.around").alias("there"),
        F.col("first.windows").alias("told"), "n",
    )
    known = keep(_with_seeds(held, keep(first, "first-seeds")), "known-seeds")
    code = F.struct("around", "there").alias("code")
    single = known.where("doc_id <> source_id").select("doc_id", "source_id", _link("place", "at").alias("link"), code)
    pairs = _pair_links(known.select("seed", "doc_id", "place", "source_id", "at"))
    both = single.unionByName(pairs, allowMissingColumns=True).unionByName(_window_links(known), allowMissingColumns=True)
    links = both.groupBy("doc_id", "source_id").agg(
        F.collect_set("link").alias("links"), F.collect_set("run").alias("runs"), F.max("code").alias("code")
    )
    if least_words <= SEED_WORDS + 2 * AROUND:
        chance = F.lit(False)
    else:
        chance = (F.size("links") == 1) & (F.size("runs") == 0) & stuck(F.col("code.around"), F.col("code.there"), least)
    links = links.where(~chance).select("doc_id", "source_id", "links", "runs")
    links = keep(links.mapInArrow(_chain_rows, "doc_id bigint, source_id bigint, chains array<array<bigint>>"), "links-of-pairs")
    found = keep(_passages_of(links, rows, SURROUNDINGS, least_words, least), "passages")
    cut_off = keep(found.where("chains is not null").select("doc_id", "source_id", "chains").distinct(), "cut-off")
    # Few documents: where their ids can be broadcast, the other texts aren't moved again.
    again = keep(cut_off.select("doc_id").union(cut_off.select("source_id")).distinct(), "cut-off-documents")
    whole = _passages_of(cut_off, rows.join(again, "doc_id", "left_semi"), None, least_words, least)
    found = found.where("chains is null").unionByName(whole).drop("chains")
    size = F.greatest(F.col("last_word") - F.col("first_word"), F.col("source_last") - F.col("source_first"))
    return found.distinct().withColumn("similarity", F.col("n_aligned") / size)
