"""Phone extraction as native expressions: one text in, an array of candidates out.

Stages:

1. ``spans``       number-shaped runs with their 0-based code-point offsets
2. ``candidates``  raw text, E.164 form and context of each run
3. ``accepted``    the ones that survive the validity and false-positive rules
4. ``phones``      first candidate per E.164, in text order
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import text as tx

# ---- fixed value: number shapes, on text with ASCII digits ----------------------
_SEP = r"[\s.\-/()]{0,2}"
NUMBER_RUN = (
    r"(?<![\w+])(?<!\d[ .\-/])"
    r"(?:"
    rf"\+\d(?:{_SEP}\d){{10}}(?:(?:{_SEP}\d){{2}})?"  # + and 11 or 13 digits
    rf"|00{_SEP}\d(?:{_SEP}\d){{10}}"  # 00 and 11 digits
    rf"|{vocab.HOME_COUNTRY_CODE}{_SEP}\d(?:{_SEP}\d){{7}}"  # bare country code
    rf"|\(?\d(?:{_SEP}\d){{7}}"  # 8 local digits
    r")"
    r"(?![ .\-/]?\d)(?!\w)"
)

# What every number run contains; cheap to look for.
_ANY_DIGIT = f"[0-9{tx.OTHER_DIGIT_CLASS}]"
MAYBE_NUMBER = rf"{_ANY_DIGIT}(?:{_SEP}{_ANY_DIGIT}){{7}}"

_MARK = "\x01"
_SPAN = "array<struct<start:int,n:int>>"
PHONES = "array<struct<raw:string,e164:string,valid:boolean,region:string,kind:string>>"


def _marked(text: Column) -> Column:
    """Digits made ASCII and every number run put between two marks, in one regex pass.

    A mark that stands in the text already is exchanged for its neighbour first; both are
    outside every class that the pattern names, so matches and offsets are the same.
    """
    plain = F.replace(tx.ascii_digits(text), F.lit(_MARK), F.lit("\x02"))
    return F.regexp_replace(plain, f"({NUMBER_RUN})", f"{_MARK}$1{_MARK}")


def spans(text: Column) -> Column:
    """Offsets and lengths, in code points, of the number runs of a text."""
    parts = F.split(_marked(text), _MARK, -1)
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(_SPAN).alias("out")
    )

    def step(acc: Column, part: Column) -> Column:
        n = F.length(part)
        span = F.struct(acc["pos"].alias("start"), n.alias("n"))
        return F.struct(
            (acc["pos"] + n).alias("pos"),
            (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def e164(raw: Column) -> Column:
    """E.164 form of a raw number by its digit count and prefix; null when there is none."""
    ascii_raw = tx.ascii_digits(raw)
    digits = F.regexp_replace(ascii_raw, r"\D", "")
    n = F.length(digits)
    return (
        F.when(n == 8, F.concat(F.lit("+" + vocab.HOME_COUNTRY_CODE), digits))
        .when(n == 11, F.concat(F.lit("+"), digits))
        .when((n == 13) & digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, 3, 11)))
        .when((n == 13) & ascii_raw.contains("+"), F.concat(F.lit("+"), digits))
    )


#: Every known (country code, national length).
ALL_COUNTRIES = tuple((code, length) for code, lengths in vocab.OTHER_COUNTRIES.items() for length in lengths)


def foreign_pattern(countries: Sequence[tuple[str, int]]) -> str:
    return r"^\+(?:" + "|".join(rf"{code}\d{{{length}}}" for code, length in countries) + ")$"


def is_valid_number(number: Column, other_countries: Sequence[tuple[str, int]] = ALL_COUNTRIES) -> Column:
    """Known numbering plans: home prefixes, NANP and (code, national length) pairs, all known countries by default."""
    home = "+" + vocab.HOME_COUNTRY_CODE
    valid = (
        number.startswith(home)
        & (F.length(number) == len(home) + 8)
        & F.substring(number, len(home) + 1, 2).rlike(vocab.HOME_PREFIX)
    )
    valid = valid | (number.startswith("+1") & F.substring(number, 3, 20).rlike(vocab.NANP_NATIONAL))
    if other_countries:
        valid = valid | number.rlike(foreign_pattern(other_countries))
    return F.coalesce(valid, F.lit(False))


def line_kind(number: Column, kinds: Mapping[str, str] | None = None) -> Column:
    """mobile, landline, fixed_or_mobile or unknown, by the local number's longest known prefix."""
    table = vocab.HOME_LINE_KINDS if kinds is None else kinds
    home = "+" + vocab.HOME_COUNTRY_CODE
    out = F.lit("unknown")
    for prefix in sorted(table, key=len):
        out = F.when(number.startswith(home + prefix), F.lit(table[prefix])).otherwise(out)
    return out


def is_date(raw: Column) -> Column:
    """Day, month and year in the shape of a number."""
    shape = tx.ascii_digits(raw)
    parts = F.split(F.trim(shape), r"[./\-]", -1)
    day = F.try_element_at(parts, F.lit(1)).try_cast("int")
    month = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return shape.rlike(vocab.DATE_SHAPE) & F.coalesce(day.between(1, 31) & month.between(1, 12), F.lit(False))


def has_known_digit_count(raw: Column) -> Column:
    return F.length(tx.digits_only(raw)).isin(*vocab.PHONE_DIGIT_COUNTS)


def looks_like_sizes(raw: Column, around: Column) -> Column:
    """Four or more groups, the first four of two digits each, next to a size word."""
    groups = F.regexp_extract_all(tx.ascii_digits(raw), F.lit(r"\d+"), F.lit(0))
    return (
        (F.size(groups) >= 4)
        & F.forall(F.slice(groups, 1, 4), lambda g: F.length(g) == 2)
        & around.rlike(vocab.SIZE_CONTEXT)
    )


def has_phone_marker(before: Column) -> Column:
    """Do the characters just before a number end in a phone word or sign?"""
    return before.rlike(vocab.PHONE_MARKER)


def is_false_positive(
    raw: Column, number: Column, around: Column, before: Column, price_pattern: str = vocab.PRICE_CONTEXT
) -> Column:
    """Dates, odd lengths, foreign prefixes under the home code, size lists and prices."""
    home = "+" + vocab.HOME_COUNTRY_CODE
    return (
        is_date(raw)
        | ~has_known_digit_count(raw)
        | (number.startswith(home) & ~F.substring(number, len(home) + 1, 2).rlike(vocab.HOME_PREFIX))
        | looks_like_sizes(raw, around)
        | (around.rlike(price_pattern) & ~has_phone_marker(before))
    )


def candidates(text: Column, number_spans: Column) -> Column:
    """Raw text, E.164 and surroundings of each span; taken from the original text."""

    def describe(span: Column) -> Column:
        start, end = span["start"], span["start"] + span["n"]
        raw = F.substring(text, start + 1, span["n"])
        return F.struct(
            F.trim(raw).alias("raw"),
            e164(raw).alias("e164"),
            tx.context(text, start, end, vocab.PHONE_CONTEXT_RADIUS).alias("around"),
            F.substring(
                text,
                F.greatest(start - vocab.PHONE_MARKER_REACH, F.lit(0)) + 1,
                F.least(start, F.lit(vocab.PHONE_MARKER_REACH)),
            ).alias("before"),
        )

    return F.transform(number_spans, describe)


def accepted(
    found: Column,
    other_countries: Sequence[tuple[str, int]] = ALL_COUNTRIES,
    price_pattern: str = vocab.PRICE_CONTEXT,
) -> Column:
    return F.filter(
        found,
        lambda c: is_valid_number(c["e164"], other_countries)
        & ~is_false_positive(c["raw"], c["e164"], c["around"], c["before"], price_pattern),
    )


def first_per_number(found: Column, kinds: Mapping[str, str] | None = None) -> Column:
    """One entry per E.164, the first raw form kept, in text order."""
    numbers = F.transform(found, lambda c: c["e164"])
    firsts = F.filter(found, lambda c, i: F.array_position(numbers, c["e164"]) == i + 1)
    return F.transform(
        firsts,
        lambda c: F.struct(
            c["raw"].alias("raw"),
            c["e164"].alias("e164"),
            F.lit(True).alias("valid"),
            F.lit(vocab.HOME_REGION).alias("region"),
            line_kind(c["e164"], kinds).alias("kind"),
        ),
    )


def phones(
    text: Column,
    *,
    other_countries: Sequence[tuple[str, int]] = ALL_COUNTRIES,
    kinds: Mapping[str, str] | None = None,
    price_pattern: str = vocab.PRICE_CONTEXT,
) -> Column:
    """``array<struct<raw,e164,valid,region,kind>>`` of a text; null counts as empty.

    Texts without eight digits in near sequence skip the number pattern altogether.
    """

    def extracted(t: Column) -> Column:
        found = tx.let(spans(t), lambda s: accepted(candidates(t, s), other_countries, price_pattern))
        return F.when(t.rlike(MAYBE_NUMBER), tx.let(found, lambda f: first_per_number(f, kinds))).otherwise(
            F.array().cast(PHONES)
        )

    return tx.let(F.coalesce(text, F.lit("")), extracted)


def with_phones(df: DataFrame, text_col: str = "text", out: str = "phones", **options) -> DataFrame:
    """Add the phones of a text to every row; no shuffle."""
    return df.withColumn(out, phones(F.col(text_col), **options))


def only_with_phones(df: DataFrame, text_col: str = "text", out: str = "phones", **options) -> DataFrame:
    """The rows whose text holds a phone, with their phones.

    Written as a generator instead of a filter: a filter would be moved to the scan and the
    extraction would run there and again for the column.
    """
    found = tx.let(phones(F.col(text_col), **options), lambda p: F.when(F.size(p) > 0, F.array(p)))
    return df.select("*", F.explode_outer(found).alias(out)).filter(F.col(out).isNotNull())
