"""Time stamps written for people, relative to the moment of capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import text as tx

# ---- fixed values: unit words (seconds .. years), dual forms, day words, formats ----
UNIT_WORDS = {
    "second": "s|sec|secs|second|seconds|seconde|secondes|ثانية|ثواني|ثوان",
    "minute": "m|min|mins|minute|minutes|دقيقة|دقائق",
    "hour": "h|hr|hrs|hour|hours|heure|heures|ساعة|ساعات",
    "day": "d|j|day|days|jour|jours|يوم|أيام|ايام",
    "week": "w|week|weeks|semaine|semaines|sem|أسبوع|اسبوع|أسابيع",
    "month": "month|months|mois|شهر|أشهر|شهور",
    "year": "y|yr|yrs|year|years|an|ans|année|années|سنة|سنوات|عام|أعوام",
}
DUAL_WORDS = {
    "second": "ثانيتين",
    "minute": "دقيقتين",
    "hour": "ساعتين",
    "day": "يومين",
    "week": "أسبوعين|اسبوعين",
    "month": "شهرين",
    "year": "سنتين|عامين",
}
ONE_WORDS = "a|an|one|un|une"
NOW_WORDS = "now|just now|maintenant|à l'instant|الآن"
TODAY_WORDS = "today|aujourd'hui|اليوم"
YESTERDAY_WORDS = "yesterday|hier|أمس|امس"
# Days from Monday on, months from January on: English, French, Arabic.
WEEKDAYS = (
    "monday|mon|lundi|lun|الاثنين|الإثنين",
    "tuesday|tue|mardi|mar|الثلاثاء",
    "wednesday|wed|mercredi|mer|الأربعاء|الاربعاء",
    "thursday|thu|jeudi|jeu|الخميس",
    "friday|fri|vendredi|ven|الجمعة",
    "saturday|sat|samedi|sam|السبت",
    "sunday|sun|dimanche|dim|الأحد|الاحد",
)
MONTHS = (
    "january|jan|janvier|janv|يناير|جانفي",
    "february|feb|février|fevrier|févr|fevr|fév|فبراير|فيفري",
    "march|mar|mars|مارس",
    "april|apr|avril|avr|أبريل|ابريل|أفريل|افريل",
    "may|mai|مايو|ماي",
    "june|jun|juin|يونيو|جوان",
    "july|jul|juillet|juil|يوليو|جويلية",
    "august|aug|août|aout|أغسطس|اغسطس|أوت|اوت",
    "september|sep|sept|septembre|سبتمبر",
    "october|oct|octobre|أكتوبر|اكتوبر",
    "november|nov|novembre|نوفمبر",
    "december|dec|décembre|decembre|déc|ديسمبر",
)
DATE_FORMATS = ("M d yyyy", "d M yyyy")
# How a text with such a clock time ends, in capitals; no clock time otherwise.
CLOCK_FORMATS = {" h:mm a": r" \d{1,2}:\d{2} [AP]M$", " H:mm:ss": r" \d{1,2}:\d{2}:\d{2}$", " H:mm": r" \d{1,2}:\d{2}$"}
NUMERIC_DATES = {"/": "d/M/yyyy", ".": "d.M.yyyy", "-": "d-M-yyyy"}


_MONTH_OF = {w: str(i) for i, words in enumerate(MONTHS, 1) for w in words.split("|")}
_DAY_OF = {w: i for i, words in enumerate(WEEKDAYS) for w in words.split("|")}
_ANY_MONTH = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
_ANY_DAY = "|".join(sorted(_DAY_OF, key=len, reverse=True))
_CLOCK = r"(?:\s*(?:at|à|,|الساعة)?\s*(\d{1,2})[:h](\d{2})\s*(am|pm)?)?$"
_UNIT_OF = {w: unit for unit, words in UNIT_WORDS.items() for w in words.split("|")}
_DUAL_OF = {w: unit for unit, words in DUAL_WORDS.items() for w in words.split("|")}
_COUNTED = rf"^(il y a|منذ|قبل|since|about)?\s*(?:(\d{{1,5}})|({ONE_WORDS})\s)?\s*(\p{{L}}+)(?:\s+ago)?$"


def _minus(base: Column, n: Column, unit: Column) -> Column:
    steps = {
        "second": F.make_interval(secs=n),
        "minute": F.make_interval(mins=n),
        "hour": F.make_interval(hours=n),
        "day": F.make_interval(days=n),
        "week": F.make_interval(weeks=n),
        "month": F.make_interval(months=n),
        "year": F.make_interval(years=n),
    }
    out = F.lit(None).cast("timestamp")
    for name, step in steps.items():
        out = F.when(unit == name, base - step).otherwise(out)
    return out


def _relative(shown: Column, base: Column) -> Column:
    """A number (or one, or an Arabic dual) and a unit, counted back from ``base``."""
    part = lambda i: F.regexp_extract(shown, _COUNTED, i)

    def counted(word: Column) -> Column:
        dual = F.try_element_at(tx.map_literal(_DUAL_OF), word)
        bare_one = (part(3) != "") | part(1).isin("منذ", "قبل")
        n = F.coalesce(part(2).try_cast("int"), F.when(dual.isNotNull(), 2), F.when(bare_one, 1))
        return F.when(
            word != "", _minus(base, n, F.coalesce(dual, F.try_element_at(tx.map_literal(_UNIT_OF), word)))
        )

    return tx.let(part(4), counted)


def _at_clock(shown: Column, pattern: str, day: Column, same_time: Column) -> Column:
    """Midnight ``day`` plus the pattern's clock time; without one ``same_time``."""
    hour, minute, half = (F.regexp_extract(shown, pattern, i) for i in (1, 2, 3))
    hour, minute = hour.try_cast("int"), minute.try_cast("int")
    hour24 = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    return F.when(hour.isNull(), same_time).otherwise(day + F.make_interval(hours=hour24, mins=minute))


def _named_day(shown: Column, base: Column) -> Column:
    """Now, today, yesterday, or the last such weekday before ``base``."""
    out = F.when(shown.rlike(rf"^(?:{NOW_WORDS})$"), base)
    today = F.date_trunc("day", base)
    for words, back in ((TODAY_WORDS, 0), (YESTERDAY_WORDS, 1)):
        pattern = rf"^(?:{words}){_CLOCK}"
        step = F.make_interval(days=F.lit(back))
        out = out.when(shown.rlike(pattern), _at_clock(shown, pattern, today - step, base - step))
    pattern = rf"^(?:{_ANY_DAY}){_CLOCK}"
    day = F.try_element_at(tx.map_literal(_DAY_OF), F.regexp_extract(shown, rf"^({_ANY_DAY})", 1))
    # Monday is 0 here and in weekday(); the same weekday is a week ago.
    back = F.pmod(F.weekday(base) - day - 1, F.lit(7)) + 1
    midnight = today - F.make_interval(days=back)
    return out.when(shown.rlike(pattern), _at_clock(shown, pattern, midnight, midnight))


def _plain_date(plain: Column, base: Column) -> Column:
    """Numeric dates (day first), and dates with a month's name; without a year that of ``base``. ``plain`` is bound."""
    month = rf"(?<![\p{{L}}])({_ANY_MONTH})(?![\p{{L}}])\.?"
    numbered = tx.rewrite_matches(
        plain, month, lambda w: F.try_element_at(tx.map_literal(_MONTH_OF), F.regexp_replace(w, r"\.$", ""))
    )
    named = F.when(plain.rlike(month), tx.collapse_spaces(numbered))
    # Where the month stood tells which number it is: marked texts keep the order of the words.
    month_first = plain.rlike(rf"^(?:{_ANY_MONTH})(?![\p{{L}}])")
    with_year = tx.let(
        named,
        lambda p: F.when(p.rlike(r"^\d{1,2} \d{1,2} \d{4}\b"), p).otherwise(
            F.regexp_replace(p, r"^(\d{1,2} \d{1,2})\b", F.concat(F.lit("$1 "), F.year(base).cast("string")))
        ),
    )

    def read(text: Column, date: str) -> Column:
        """One parse: the end of the text tells its format."""

        def by_clock(upper: Column) -> Column:
            out = F.try_to_timestamp(upper, F.lit(date))
            for clock, ending in CLOCK_FORMATS.items():
                out = F.when(upper.rlike(ending), F.try_to_timestamp(upper, F.lit(date + clock))).otherwise(out)
            return out

        return tx.let(F.upper(text), by_clock)

    dated = tx.let(with_year, lambda d: F.when(month_first, read(d, DATE_FORMATS[0])).otherwise(read(d, DATE_FORMATS[1])))
    numeric = F.lit(None).cast("timestamp")
    for mark, date in NUMERIC_DATES.items():
        numeric = F.when(F.regexp_extract(plain, r"^\d{1,2}([/.\-])", 1) == mark, read(plain, date)).otherwise(numeric)
    return F.coalesce(dated, numeric)


def _absolute(shown: Column, base: Column) -> Column:
    """ISO times, and dates without their weekday and joining words, see ``_plain_date``."""
    plain = F.regexp_replace(shown, rf"^(?:{_ANY_DAY})(?![\p{{L}}])[,.]?\s*", "")
    plain = tx.collapse_spaces(F.regexp_replace(plain, r",|(?<!\S)(?:at|à|الساعة)(?!\S)", " "))
    iso = F.when(shown.rlike(r"^\d{4}-\d{2}-\d{2}"), F.upper(shown).try_cast("timestamp"))
    return F.coalesce(iso, tx.let(plain, lambda p: _plain_date(p, base)))


def parse_timestamp(text: Column, captured_at: Column) -> Column:
    """UTC time of a relative or absolute time text; blank or unknown forms give null.

    Relative forms count back from ``captured_at``, so a re-run gives the same result.
    """
    return tx.let(
        F.struct(F.lower(tx.collapse_spaces(text)).alias("shown"), captured_at.cast("timestamp").alias("base")),
        lambda s: F.coalesce(
            _relative(s["shown"], s["base"]), _named_day(s["shown"], s["base"]), _absolute(s["shown"], s["base"])
        ),
    )


def to_unix(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def age_days(captured_at: Column, now: Column) -> Column:
    """Age in days; null for a missing or unreadable time."""
    captured = captured_at.try_cast("timestamp")
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(captured)) / F.lit(86_400_000_000)


def is_fresh(captured_at: Column, now: Column, max_age_days: float = 30) -> Column:
    return F.coalesce(age_days(captured_at, now) <= max_age_days, F.lit(False))
