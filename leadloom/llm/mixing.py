"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the characters over its present share. Each document draws
its number of copies from a Poisson distribution with that mean, by inverting the distribution at a number in (0, 1)
that a hash of seed and id gives. The copies are dealt over the partitions by a hash of their own and sorted by it.

The rates are one row per source; they are broadcast only after a count shows that they are few.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import keep, shuffle_partitions, whole_text
from leadloom.session import broadcast_if_few

SEED = "mix-1"
ALPHA = 0.5
_HEX = 13  # 52 bits of the hash


def hashed_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    whole = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("double")
    return (whole + 0.5) / F.lit(float(16**_HEX))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0 … up to where the rest is below the hash's resolution; logarithms keep large rates exact."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    log_rate = F.ln(rate)

    def next_step(acc: Column, k: Column) -> Column:
        term = acc["term"] + log_rate - F.ln(k.cast("double"))
        total = acc["total"] + F.exp(term)
        return F.struct(term.alias("term"), total.alias("total"), F.array_append(acc["steps"], total).alias("steps"))

    start = F.struct((-rate).alias("term"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))
    steps = F.aggregate(F.sequence(F.lit(1), last), start, next_step, lambda acc: acc["steps"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    budget: float = 1.0,
    alpha: float = ALPHA,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``__source``, ``rate``: mean copies of a document of each source, over all documents.

    ``weights`` names the target shares (sources that it does not name get none); without it a source's share is its
    number of characters to the power ``alpha``. ``budget`` is the size of the mix against the input.
    """
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(F.length(whole_text(text_col))).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else None
        weight = F.lit(0.0) if named is None else F.coalesce(named[F.coalesce("__source", F.lit("\0"))], F.lit(0.0))
    sizes = keep(sizes.withColumn("weight", weight), "source-sizes")
    total, weighed = sizes.agg(F.sum("chars"), F.sum("weight")).first()
    if not total or not weighed:
        return sizes.select("__source", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(weighed)) * F.lit(float(total) * budget)
    return sizes.select("__source", F.when(F.col("chars") > 0, share / F.col("chars")).otherwise(0.0).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    budget: float = 1.0,
    alpha: float = ALPHA,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The drawn copies with all columns of ``docs``, and ``copy`` (from 1), ``rate``, ``shuffle_key``; globally shuffled.

    A null source is a source of its own. Null texts count as empty; a source of empty texts only gets none. A null id
    draws as an empty id; rows that repeat an id draw alike. Columns of ``docs`` named like the added ones are replaced.
    """
    added = ("copy", "rate", "shuffle_key")
    rates = keep(
        source_rates(docs, weights, budget, alpha, source_col, text_col).withColumn("__steps", poisson_steps(F.col("rate"))),
        "source-rates",
    )
    docs = docs.drop(*added)
    drawn = docs.join(broadcast_if_few(rates), F.col(source_col).eqNullSafe(F.col("__source")))
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    unit = hashed_unit(F.lit(seed), identity)
    copies = F.size(F.filter("__steps", lambda step: step < F.col("__unit")))
    copy = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    drawn = drawn.withColumn("__unit", unit).withColumn("__copies", copies).where("__copies > 0")
    drawn = drawn.select(*docs.columns, copy.alias("copy"), "rate")
    key = F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), identity, F.col("copy"))), 1, 16)
    n = shuffle_partitions(docs.sparkSession)
    return drawn.withColumn("shuffle_key", key).repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
