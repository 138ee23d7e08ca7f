"""Row filters by keyword, and keyword groups as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as tx


def text_matches(df: DataFrame, keywords: Sequence[str], text_col: str = "text", out: str = "matches") -> DataFrame:
    """Add whether the text holds any keyword, without regard to case and accents."""
    return df.withColumn(out, tx.matches_any_keyword(F.col(text_col), keywords))


def match_labels(
    df: DataFrame,
    include: Sequence[str],
    regexes: Sequence[str] = (),
    exclude: Sequence[str] = (),
    *,
    text_col: str = "text",
    max_len: int = 200,
    limit: int | None = None,
) -> DataFrame:
    """Rows whose normalised text has 1 to ``max_len`` characters, holds a keyword or matches a
    regex, and holds no excluded word."""

    def holds(norm: Column, words: Sequence[str]) -> Column:
        folded = list(dict.fromkeys(tx.fold_str(w) for w in words))
        return F.exists(F.lit(folded), lambda w: F.contains(norm, w)) if folded else F.lit(False)

    def wanted(norm: Column) -> Column:
        hit = holds(norm, include)
        for pattern in regexes:
            hit = hit | norm.rlike("(?iU)" + pattern)
        return F.length(norm).between(1, max_len) & hit & ~holds(norm, exclude)

    kept = df.filter(tx.let(tx.collapse_spaces(tx.fold(F.col(text_col))), wanted))
    return kept if limit is None else kept.limit(limit)
