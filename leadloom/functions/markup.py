"""Elements of a page by matching its tags, in native expressions and without arrays that grow step by step.

A page is cut once into alternating text and tags (``markup``). The tags of one name are +1 or -1; their running sum is the
depth, and an opening tag's end is the next closing tag of its depth, its neighbour after sorting by depth and place. Running
sums are scans by doubling: ``log2 n`` passes over the array, so all work is O(n log n) in the tags of a page. Elements
are pairs of token numbers, so cutting one out never counts characters from the page's beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import text as tx

#: Names of the tags that pages are cut at.
TAG_NAMES = ("article", "div", "ul", "li")
_TAG = rf"(?is)(<(?:{'|'.join(TAG_NAMES)})(?:\s[^>]*)?>|</(?:{'|'.join(TAG_NAMES)})\s*>)"
#: Stands around tags while a page is split. Where a page holds it itself, it and the escape are written as two characters.
_MARK, _ESCAPE = "\x01", "\x02"
SPAN = "array<struct<first:int,last:int>>"


# ---- arrays in linear or n log n steps --------------------------------------------


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each value and all before it; ``op(before, value)`` is associative and gets null before the first one."""
    n = F.size(values)
    passes = F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), F.when(n > 1, F.length(F.bin((n - 1).cast("bigint")))).otherwise(F.lit(0)))

    def doubled(acc: Column, k: Column) -> Column:
        return tx.let(
            F.call_function("shiftleft", F.lit(1), k), lambda d: F.transform(acc, lambda v, i: op(F.get(acc, i - d), v))
        )

    return F.aggregate(passes, values, doubled)


def running_sum(values: Column) -> Column:
    return running(values, lambda before, v: F.coalesce(before, F.lit(0)) + v)


def last_known(values: Column) -> Column:
    """Nulls become the last value before them."""
    return running(values, lambda before, v: F.coalesce(v, before))


def first_of_equal(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first value of each key, in their order; null keys equal each other."""

    def firsts(ranked: Column) -> Column:
        new = lambda r, j: (j == 0) | ~r["k"].eqNullSafe(F.get(ranked, j - 1)["k"])
        return F.sort_array(F.transform(F.filter(ranked, new), lambda r: r["i"]))

    def kept(vs: Column) -> Column:
        ranked = F.sort_array(F.transform(vs, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"))))
        return F.transform(tx.let(ranked, firsts), lambda i: F.get(vs, i))

    return tx.let(values, kept)


# ---- tags -------------------------------------------------------------------------


def _escaped(html: Column) -> Column:
    def doubled(h: Column) -> Column:
        marked = F.replace(F.replace(h, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
        return F.when(h.contains(_MARK) | h.contains(_ESCAPE), marked).otherwise(h)

    return tx.let(html, doubled)


def _unescaped(text: Column) -> Column:
    def plain(t: Column) -> Column:
        single = F.replace(F.replace(t, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
        return F.when(t.contains(_ESCAPE), single).otherwise(t)

    return tx.let(text, plain)


def markup(html: Column) -> Column:
    """``struct<tokens, tags>``: text and tags in turn (tag ``t`` is token ``2t + 1``), and the name and step of each tag.

    The step is 1 for an opening, -1 for a closing and 0 for a self-closing tag. Bind it with ``text.let``.
    """

    def described(tokens: Column) -> Column:
        n = F.floor(F.size(tokens) / 2).cast("int")
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def tag(t: Column) -> Column:
            name = lambda tag: F.lower(F.regexp_extract(tag, r"^</?([A-Za-z]+)", 1))
            step = lambda tag: F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), 0).otherwise(1)
            own = F.get(tokens, 2 * t + 1)
            return tx.let(own, lambda o: F.struct((2 * t + 1).alias("at"), name(o).alias("name"), step(o).alias("step")))

        return F.struct(tokens.alias("tokens"), F.transform(numbers, tag).alias("tags"))

    cut = F.split(F.regexp_replace(_escaped(html), _TAG, f"{_MARK}$1{_MARK}"), _MARK, -1)
    return tx.let(cut, described)


def elements(page: Column, tag: str) -> Column:
    """``array<struct<first,last>>``: first token and the one behind the last, of the elements ``tag``.

    Nested elements are found too; they come in the order of their beginnings. A closing tag without an open element is
    ignored; an element that is never closed runs to the end.
    """
    tokens = page["tokens"]
    none = F.array().cast(SPAN)

    def levelled(tags: Column) -> Column:
        def with_depths(sums: Column) -> Column:
            # Surplus closing tags pull the sum below zero: the depth is counted from its least value so far.
            floor = running(sums, lambda before, v: F.least(before, v))
            return tx.let(floor, lambda least: F.transform(sums, lambda s, i: s - F.least(F.get(least, i), F.lit(0))))

        def ranked(depths: Column) -> Column:
            def level(t: Column, i: Column) -> Column:
                before = F.coalesce(F.get(depths, i - 1), F.lit(0))
                return F.struct(
                    F.when(t["step"] == 1, F.get(depths, i)).otherwise(before).alias("level"),
                    t["at"].alias("at"),
                    t["step"].alias("step"),
                )

            return F.sort_array(F.filter(F.transform(tags, level), lambda t: t["level"] > 0))

        return tx.let(tx.let(running_sum(F.transform(tags, lambda t: t["step"])), with_depths), ranked)

    def paired(order: Column) -> Column:
        def span(t: Column, j: Column) -> Column:
            following = F.get(order, j + 1)
            closed = F.coalesce((following["level"] == t["level"]) & (following["step"] == -1), F.lit(False))
            last = F.when(closed, following["at"] + 1).otherwise(F.size(tokens))
            return F.when(t["step"] == 1, F.struct(t["at"].alias("first"), last.alias("last")))

        return F.sort_array(F.filter(F.transform(order, span), lambda s: s.isNotNull()))

    own = F.filter(page["tags"], lambda t: (t["name"] == tag) & (t["step"] != 0))
    return tx.let(own, lambda tags: F.when(F.size(tags) > 0, tx.let(levelled(tags), paired)).otherwise(none))


def matching(page: Column, spans: Column, wanted: str) -> Column:
    """The spans whose opening tag matches."""
    return spans if wanted == "." else F.filter(spans, lambda s: F.get(page["tokens"], s["first"]).rlike(wanted))


def outermost(spans: Column) -> Column:
    """Of spans in the order of their beginnings, those that lie in no other one."""

    def kept(ss: Column) -> Column:
        reach = running(F.transform(ss, lambda s: s["last"]), lambda before, v: F.greatest(before, v))
        return tx.let(reach, lambda far: F.filter(ss, lambda s, i: (i == 0) | (s["first"] >= F.get(far, i - 1))))

    return tx.let(spans, lambda ss: F.when(F.size(ss) > 1, kept(ss)).otherwise(ss))


def inside(spans: Column, holders: Column) -> Column:
    """The spans that begin in one of ``holders``, which don't overlap; in the order of their beginnings."""
    moment = lambda at, kind, last: F.struct(at.alias("at"), F.lit(kind).alias("kind"), last.alias("last"))
    zero = F.lit(0)
    moments = F.concat(
        F.transform(holders, lambda h: moment(h["first"], 1, zero)),
        F.transform(holders, lambda h: moment(h["last"], -1, zero)),
        F.transform(spans, lambda s: moment(s["first"], 0, s["last"])),
    )

    def held(ms: Column) -> Column:
        open_ = running_sum(F.transform(ms, lambda m: m["kind"]))
        found = tx.let(open_, lambda o: F.filter(ms, lambda m, i: (m["kind"] == 0) & (F.get(o, i) > 0)))
        return F.transform(found, lambda m: F.struct(m["at"].alias("first"), m["last"].alias("last")))

    return tx.let(F.sort_array(moments), held)


def span_text(page: Column, first: Column, last: Column) -> Column:
    return _unescaped(F.array_join(F.slice(page["tokens"], first + 1, F.greatest(last - first, F.lit(0))), ""))


def element_texts(page: Column, spans: Column) -> Column:
    """``array<string>``: those elements, their own tags included."""
    return F.transform(spans, lambda s: span_text(page, s["first"], s["last"]))


def without_spans(page: Column, spans: Column) -> Column:
    """The page without spans that don't overlap, in order; blanks stand where they were."""

    def pieces(ss: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ss, i - 1)["last"])
        end = lambda i: F.coalesce(F.get(ss, i)["first"], F.size(page["tokens"]))
        numbers = F.sequence(F.lit(0), F.size(ss))
        return F.array_join(F.transform(numbers, lambda i: span_text(page, begin(i), end(i))), " ")

    return tx.let(spans, pieces)
