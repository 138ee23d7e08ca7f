"""Rule-table intent classification: weighted keywords, exclusions, evidence.

Two forms give the same scores, neither with a shuffle. Small rule tables travel inside the
plan as an array literal. For larger ones, the texts pass one automaton of all keywords in
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from leadloom import vocab
from leadloom.functions import text as tx

# Rule tables with more keywords than this are looked for by an automaton, not by literals of the plan.
MAX_LITERAL_KEYWORDS = 2_000


@dataclass(frozen=True)
class IntentRule:
    """One row of the rule table."""

    intent: str
    language: str
    keywords: tuple[str, ...]
    weight: float = 1.0
    require_phone: bool = False
    exclude_keywords: tuple[str, ...] = ()


def keyword_count(rules: Sequence[IntentRule]) -> int:
    return sum(len(r.keywords) + len(r.exclude_keywords) for r in rules)


def normalise(text: Column) -> Column:
    """ASCII digits, no links, single blanks, case folded."""
    return tx.casefold(tx.compact_text(tx.ascii_digits(text)))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _rule_literal(rules: Sequence[IntentRule]) -> Column:
    word = "array<struct<word:string,folded:string>>"
    return F.array(
        *[
            F.struct(
                F.lit(r.intent).alias("intent"),
                F.lit(float(r.weight)).alias("weight"),
                F.lit(r.require_phone).alias("require_phone"),
                F.array(
                    *[
                        F.struct(F.lit(k).alias("word"), F.lit(tx.casefold_str(k)).alias("folded"))
                        for k in r.keywords
                    ]
                )
                .cast(word)
                .alias("keywords"),
                _strings([tx.casefold_str(k) for k in r.exclude_keywords]).alias("exclude"),
            )
            for r in rules
        ]
    )


def rule_hits(norm: Column, rules: Sequence[IntentRule], has_phone: Column) -> Column:
    """``array<struct<intent,weight,words>>``: the rules that apply, in rule order, and their keywords.

    The text is normalised once, not once per keyword.
    """

    def found(n: Column) -> Column:
        def applied(rule: Column) -> Column:
            barred = (rule["require_phone"] & ~has_phone) | F.exists(rule["exclude"], lambda k: F.contains(n, k))
            words = F.transform(F.filter(rule["keywords"], lambda k: F.contains(n, k["folded"])), lambda k: k["word"])
            return F.struct(
                rule["intent"].alias("intent"),
                rule["weight"].alias("weight"),
                F.when(barred, _strings([])).otherwise(words).alias("words"),
            )

        return F.transform(_rule_literal(rules), applied)

    return F.filter(tx.let(norm, found), lambda h: F.size(h["words"]) > 0)


def hit_score(hit: Column) -> Column:
    """A rule counts at most twice its weight."""
    return hit["weight"] * F.least(F.size(hit["words"]), F.lit(2))


def intent_scores(hits: Column) -> Column:
    """``array<struct<score,priority,intent>>`` over all intents, zero scores included."""

    def scored(name: str) -> Column:
        own = F.filter(hits, lambda h: h["intent"] == name)
        total = F.aggregate(own, F.lit(0.0), lambda acc, h: acc + hit_score(h))
        return F.struct(
            total.alias("score"),
            F.lit(vocab.INTENT_PRIORITY[name]).alias("priority"),
            F.lit(name).alias("intent"),
        )

    return F.array(*[scored(name) for name in vocab.INTENTS])


def excerpt(text: Column, clean: Column, keyword: Column, keyword_length: Column) -> Column:
    """The text around a keyword, cut marks added where it was cut.

    Positions are those in the case-folded text, lengths those of the text itself.
    """

    def around(at: Column) -> Column:
        start = F.greatest(at - vocab.EXCERPT_RADIUS, F.lit(0))
        end = F.least(at + keyword_length + vocab.EXCERPT_RADIUS, F.length(text))
        piece = F.concat(
            F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
            F.substring(text, start + 1, F.greatest(end - start, F.lit(0))),
            F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")),
        )
        return F.when(at < 0, tx.truncate(clean, vocab.EXCERPT_MISS_CAP)).otherwise(
            tx.truncate(tx.compact_text(piece), vocab.EXCERPT_CAP)
        )

    return tx.let(F.position(tx.casefold(keyword), tx.casefold(text)) - 1, around)


def verdict(text: Column, clean: Column, hits: Column, scores: Column) -> Column:
    """``struct<intent,confidence,matched_keywords,raw_excerpt>`` from the hits and scores."""

    def decided(best: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["score"])
        own = F.filter(hits, lambda h: h["intent"] == best["intent"])
        found = tx.let(
            F.flatten(F.transform(own, lambda h: h["words"])),
            lambda words: F.struct(
                best["intent"].alias("intent"),
                F.bround(best["score"] / total, 3).alias("confidence"),
                F.array_distinct(words).alias("matched_keywords"),
                tx.let(F.get(words, F.lit(0)), lambda first: excerpt(text, clean, first, F.length(first))).alias(
                    "raw_excerpt"
                ),
            ),
        )
        nothing = F.struct(
            F.lit("other").alias("intent"),
            F.lit(0.0).alias("confidence"),
            _strings([]).alias("matched_keywords"),
            tx.truncate(clean, vocab.EXCERPT_CAP).alias("raw_excerpt"),
        )
        return F.when(best["score"] > 0, found).otherwise(nothing)

    # array_max picks by score, then priority.
    return tx.let(F.array_max(scores), decided)


def classify_intents(
    df: DataFrame,
    rules: Sequence[IntentRule],
    text_col: str = "text",
    *,
    has_phone: Column | bool = True,
    out: str = "intent_result",
    max_literal_keywords: int = MAX_LITERAL_KEYWORDS,
) -> DataFrame:
    """Add the verdict struct ``out`` and the scores ``{out}_scores``; every input row is kept."""
    gate = F.lit(has_phone) if isinstance(has_phone, bool) else F.coalesce(has_phone, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judged(hits: Callable[[Column], Column]) -> Column:
        # Bound step by step: whatever the optimizer moves, nothing is computed per keyword.
        def from_hits(t: Column, h: Column) -> Column:
            return tx.let(
                intent_scores(h),
                lambda s: F.struct(verdict(t, tx.compact_text(t), h, s).alias("verdict"), s.alias("scores")),
            )

        return tx.let(text, lambda t: tx.let(hits(t), lambda h: from_hits(t, h)))

    if keyword_count(rules) <= max_literal_keywords:
        result = df.withColumn(
            "__judged", judged(lambda t: rule_hits(normalise(t), rules, gate))
        )
    else:
        result = with_scanned_hits(df, rules, normalise(text), gate)
        result = result.withColumn("__judged", judged(lambda t: F.col("__hits")))
    return result.withColumns(
        {out: F.col("__judged.verdict"), f"{out}_scores": F.col("__judged.scores")}
    ).drop("__judged", "__hits")


def _automaton(rules: Sequence[IntentRule]) -> ahocorasick.Automaton:
    """All folded keywords with their places ``(rule, place in its list, word)``; an exclusion has no place."""
    places: dict[str, list[tuple]] = {}
    for no, rule in enumerate(rules):
        for pos, word in enumerate(rule.keywords):
            places.setdefault(tx.casefold_str(word), []).append((no, pos, word))
        for word in rule.exclude_keywords:
            places.setdefault(tx.casefold_str(word), []).append((no, None, word))
    found = ahocorasick.Automaton()
    for folded, at in places.items():
        if folded:
            found.add_word(folded, at)
    found.make_automaton()
    return found


def _hits_of_text(norm: str, gate: bool, automaton: ahocorasick.Automaton, rules: Sequence[IntentRule], every: list) -> list[dict]:
    """The rules that apply to a text and their keywords, in the order of the rules and of their lists."""
    found = {id(at): at for at in ([every] if every else [])}
    if len(automaton):
        found.update((id(at), at) for _, at in automaton.iter(norm))
    words: dict[int, list] = {}
    barred = set()
    for no, pos, word in (place for at in found.values() for place in at):
        if pos is None:
            barred.add(no)
        else:
            words.setdefault(no, []).append((pos, word))
    return [
        {"intent": rules[no].intent, "weight": float(rules[no].weight), "words": [w for _, w in sorted(words[no])]}
        for no in sorted(words)
        if no not in barred and (gate or not rules[no].require_phone)
    ]


HITS = ArrayType(StructType().add("intent", "string").add("weight", "double").add("words", ArrayType(StringType())))


def with_scanned_hits(df: DataFrame, rules: Sequence[IntentRule], norm: Column, gate: Column) -> DataFrame:
    """Add ``__hits``, those of ``rule_hits``, for rule tables of any size: texts pass one automaton of all keywords.

    The work is linear in the text, whatever the number of keywords, and needs no shuffle. The automaton is built once a
    task from the rules, which the driver holds anyway. It is a step over whole rows, not a function: the optimizer would
    move a function into the expressions that use its result, which cannot call it.
    """
    rules = tuple(rules)
    # Keywords that fold to nothing are in every text.
    every = [
        (no, pos, w)
        for no, r in enumerate(rules)
        for pos, w in [*enumerate(r.keywords), *((None, w) for w in r.exclude_keywords)]
        if not tx.casefold_str(w)
    ]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(rules)
        kind = pa.list_(pa.struct([("intent", pa.string()), ("weight", pa.float64()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            texts = zip(batch.column("__norm"), batch.column("__gate"))
            hits = [_hits_of_text(n.as_py(), g.as_py(), automaton, rules, every) for n, g in texts]
            yield batch.drop_columns(["__norm", "__gate"]).append_column("__hits", pa.array(hits, kind))

    asked = df.withColumns({"__norm": norm, "__gate": gate})
    return asked.mapInArrow(scan, StructType(df.schema.fields).add("__hits", HITS))
