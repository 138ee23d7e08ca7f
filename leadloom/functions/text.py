"""Text scalars as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


OTHER_DIGIT_CLASS = "٠-٩۰-۹"
OTHER_DIGITS = vocab.ARABIC_INDIC_DIGITS + vocab.EASTERN_ARABIC_INDIC_DIGITS


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic and Eastern Arabic-Indic digits to ASCII; offsets stay as they are.

    ``translate`` is slow per character, so texts without such digits pass by it.
    """
    return let(
        text,
        lambda t: F.when(
            t.rlike(f"[{OTHER_DIGIT_CLASS}]"), F.translate(t, OTHER_DIGITS, "0123456789" * 2)
        ).otherwise(t),
    )


def collapse_spaces(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed; rare kinds of space cost only texts that hold them."""
    rare = f"[{vocab.RARE_SPACE_CHARS}]"
    usual = let(text, lambda t: F.when(t.rlike(rare), F.regexp_replace(t, rare, " ")).otherwise(t))
    return F.trim(F.regexp_replace(usual, r"\s+", " "))


def compact_text(text: Column) -> Column:
    """Links removed, white space collapsed, trimmed."""
    unlinked = let(text, lambda t: F.when(t.contains("://"), F.regexp_replace(t, vocab.LINK, " ")).otherwise(t))
    return collapse_spaces(unlinked)


def extract_links(text: Column) -> Column:
    """All links in order, without trailing punctuation."""

    def found(t: Column) -> Column:
        links = F.regexp_extract_all(t, F.lit(vocab.LINK), F.lit(0))
        trimmed = F.transform(links, lambda link: F.rtrim(link, F.lit(vocab.LINK_TRAILERS)))
        return F.when(t.contains("://"), trimmed).when(t.isNotNull(), F.array().cast("array<string>"))

    return let(text, found)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(ascii_digits(text), r"\D+", "")


def context(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The characters of ``text`` from ``start - radius`` to ``end + radius`` (0-based, end exclusive)."""
    begin = F.greatest(start - radius, F.lit(0))
    return F.substring(text, begin + 1, end + radius - begin)


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def distinct_non_blank(values: Column) -> Column:
    """Ordered distinct values, blank ones dropped."""
    kept = F.filter(values, lambda v: collapse_spaces(v) != "")
    return F.array_distinct(kept)


def map_literal(table: dict[str, str]) -> Column:
    """A string map as one literal; Spark folds it to a constant. Keys and values hold no control characters."""
    return F.str_to_map(
        F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02")
    )


#: Stands for a match while a text is cut at its matches, unless the text holds it itself.
_CUT = "\x01"


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace each match of ``pattern`` by a computed text.

    The text is put together from the pieces between the matches in one pass, so no
    replacement is looked at twice.
    """

    def rewritten(t: Column) -> Column:
        def rebuild(found: Column) -> Column:
            # A split by one character compiles no pattern; a split by the pattern would, for every text.
            marked = F.split(F.regexp_replace(t, pattern, _CUT), _CUT, -1)
            pieces = F.when(t.contains(_CUT), F.split(t, pattern, -1)).otherwise(marked)
            tail = F.zip_with(
                F.transform(found, rewrite), F.slice(pieces, F.lit(2), F.size(found)), lambda m, p: F.concat(m, p)
            )
            return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

        rebuilt = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), rebuild)
        return F.when(t.rlike(pattern), rebuilt).otherwise(t)

    return let(text, rewritten)


# ---- case and accent folding ----------------------------------------------------


# All characters but ideographs, Hangul syllables, surrogates and private use, which do not fold.
_FOLDABLE_BLOCKS = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20))


@lru_cache(maxsize=None)
def _char_maps(mapper: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """Split a character mapping into its one-to-one part, for ``translate``, and the rest.

    Deleted characters close the 'from' string without a partner, which is how
    ``translate`` spells deletion. Hangul syllables are left composed.
    """
    single_from, single_to, deleted, multi = [], [], [], {}
    for char in map(chr, chain.from_iterable(range(*block) for block in _FOLDABLE_BLOCKS)):
        out = mapper(char)
        if out == char:
            continue
        if not out:
            deleted.append(char)
        elif len(out) == 1:
            single_from.append(char)
            single_to.append(out)
        else:
            multi[char] = out
    return "".join(single_from + deleted), "".join(single_to), multi


def _casefold_char(char: str) -> str:
    return char.casefold()


def _fold_char(char: str) -> str:
    decomposed = unicodedata.normalize("NFKD", char.casefold())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _char_class(chars: Sequence[str]) -> str:
    """A regex class of the characters, neighbours joined into ranges."""
    spans: list[list[int]] = []
    for code in sorted(ord(c) for c in chars):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in spans) + "]"


# What folding makes of the lower-case letters that Western European texts hold.
_LATIN_FOLDS = {
    "àáâãäå": "a", "ç": "c", "èéêë": "e", "ìíîï": "i", "ñ": "n",
    "òóôõö": "o", "ùúûü": "u", "ýÿ": "y", "ß": "ss",
}
# Outside this class, case folding changes nothing in lower-case text.
_FOLDABLE_LOWER = r"[\xb5\u0149\u017f-\u0588\u10a0-\x{10ffff}]"


def _map_matches(text: Column, pattern: str, mapper: Callable[[str], str]) -> Column:
    """Send the matches of ``pattern``, and only these, through a character mapping."""
    source, target, multi = _char_maps(mapper)
    table = map_literal(multi)
    spelled = _char_class(list(multi))

    def map_run(run: Column) -> Column:
        return rewrite_matches(F.translate(run, source, target), spelled, lambda c: F.try_element_at(table, c))

    return rewrite_matches(text, pattern, map_run)


def casefold(text: Column) -> Column:
    """Full Unicode case folding (``ß`` becomes ``ss``).

    ``lower`` and one ``replace`` do nearly all of it; the tables see rare characters only.
    """
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return _map_matches(lowered, rf"{_FOLDABLE_LOWER}+", _casefold_char)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Case folding plus removal of accents and other combining marks; null counts as empty."""

    def latin(t: Column) -> Column:
        plain = t
        for accented, letter in _LATIN_FOLDS.items():
            plain = F.regexp_replace(plain, f"[{accented}]", letter)
        return F.when(_is_ascii(t), t).otherwise(plain)

    def others(t: Column) -> Column:
        return F.when(_is_ascii(t), t).otherwise(_map_matches(t, r"[^\x00-\x7f]+", _fold_char))

    return F.coalesce(let(let(F.lower(text), latin), others), F.lit(""))


def casefold_str(text: str) -> str:
    return text.casefold()


def fold_str(text: str) -> str:
    return "".join(_fold_char(c) for c in text)


def matches_any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Does the folded text hold any folded keyword? Null and empty text: false."""
    folded_keywords = list(dict.fromkeys(fold_str(k) for k in keywords))
    if not folded_keywords:
        return F.lit(False)
    found = let(fold(text), lambda t: F.exists(F.lit(folded_keywords), lambda k: F.contains(t, k)))
    return F.coalesce((text != "") & found, F.lit(False))


# ---- masking --------------------------------------------------------------------

_PHONE_SHAPE_SEP = rf"[{vocab.SPACE_CHARS}.\-/()]*"
# ---- fixed value: the shape that is masked
PHONE_SHAPE = (
    rf"(?U)(?:(?:\+|00)?216{_PHONE_SHAPE_SEP})?\d{{2}}{_PHONE_SHAPE_SEP}\d{{3}}{_PHONE_SHAPE_SEP}\d{{3}}"
)


def mask_phones(text: Column) -> Column:
    """Every phone-shaped run keeps its country code and two digits only."""

    def masked(match: Column) -> Column:
        # The six last digits go; the two before them stay.
        digits = F.regexp_replace(match, r"(?U)\D", "")
        country = F.when(F.ltrim(match).rlike(r"^(?:\+216|00216|216)"), F.lit("+216 ")).otherwise(F.lit(""))
        return F.concat(country, F.substring(digits, F.length(digits) - 7, F.lit(2)), F.lit(" XXX XXX"))

    return rewrite_matches(text, PHONE_SHAPE, masked)


def mask_id(value: Column) -> Column:
    """Up to 8 characters: all stars; longer: first and last four stay."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4)))
    )


# ---- sentences ------------------------------------------------------------------


def sentences(clean: Column) -> Column:
    """Sentences of compacted text."""
    parts = F.transform(F.split(clean, vocab.SENTENCE_BREAK, -1), F.trim)
    return F.filter(parts, lambda s: s != "")


def first_sentence_matching(clean: Column, pattern: str) -> Column:
    """First sentence of compacted text that matches in lower case, else the whole text; at most 280 characters."""
    # A fold that keeps its first find: sentences after it are not matched.
    hit = F.aggregate(
        sentences(clean),
        F.lit(None).cast("string"),
        lambda found, s: F.coalesce(found, F.when(F.lower(s).rlike(pattern), s)),
    )
    return truncate(F.coalesce(hit, clean), vocab.SENTENCE_CAP)


def intent_json(intent: Column, confidence: Column, keywords: Column, excerpt: Column) -> Column:
    """The evidence of one classification as a JSON object."""
    return F.to_json(
        F.struct(
            intent.alias("intent"),
            confidence.alias("confidence"),
            keywords.alias("matched_keywords"),
            excerpt.alias("raw_excerpt"),
        )
    )
