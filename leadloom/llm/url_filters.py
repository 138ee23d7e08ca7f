"""URL filters by a temporal list join.

Dated list entries (block or release a domain on a list from some moment on) become validity intervals, and every
capture is checked against the intervals that were open when it was fetched. Intervals of one list and domain never
overlap; they and the captures also carry the month, so a join partner is an interval of the same domain that is open
in the capture's month.

An entry's end is the moment of the next entry of its list and domain; it comes from an equi-join on consecutive ranks,
so a domain with very many entries does not meet in one task. A domain that a third of all captures share is the hot
side of a plain equi-join, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import keep
from leadloom.operators.ranking import rank_within_key

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def url_host(url: str | Column = "url") -> Column:
    """Lower-case host of an absolute URL, else empty."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def domain_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c]``: the host and its parents of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(parents)


def _month(moment: Column) -> Column:
    return F.year(moment) * 12 + F.month(moment)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list_name, domain, valid_from, valid_to`` (null: open) of the blocking entries.

    ``entries``: list_name, domain, effective_at, action (``block``, else a release). Of entries of one list, domain and
    moment a block wins. Entries without a list, domain or moment have no effect.
    """
    moments = (
        entries.where("list_name is not null and domain is not null and effective_at is not null")
        .groupBy("list_name", F.lower("domain").alias("domain"), "effective_at")
        .agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocks"))
    )
    ranked = keep(rank_within_key(moments, ["list_name", "domain"], ["effective_at"], "rank"), "list-entries")
    following = ranked.select("list_name", "domain", (F.col("rank") - 1).alias("rank"), F.col("effective_at").alias("valid_to"))
    return (
        ranked.where("blocks")
        .join(following, ["list_name", "domain", "rank"], "left")
        .select("list_name", "domain", F.col("effective_at").alias("valid_from"), "valid_to")
    )


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per capture (id, url, fetched_at): also ``host``, ``n_lists``, ``lists`` (names, sorted, by comma), ``blocked``.

    An entry holds for its domain and all below it, from its moment on (inclusive) up to the next (exclusive). Captures
    that are alike in id, url and moment are one. A null or relative url, or no moment, is on no list. Other columns are
    ignored.
    """
    captures = captures.select(id_col, "url", "fetched_at")
    last = captures.agg(F.max("fetched_at")).first()[0]
    intervals = validity_intervals(entries)
    if last is not None:
        intervals = intervals.where(F.col("valid_from") <= F.lit(last))
    end = F.least(F.coalesce("valid_to", F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    months = F.sequence(_month(F.col("valid_from")), F.greatest(_month(end), _month(F.col("valid_from"))))
    open_in = intervals.withColumn("month", F.explode(months))
    asked = captures.withColumn("host", url_host()).withColumn("month", _month(F.col("fetched_at")))
    asked = asked.withColumn("domain", F.explode_outer(domain_suffixes(F.col("host"))))
    open_then = (F.col("fetched_at") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))
    )
    met = asked.alias("c").join(
        open_in.alias("i"),
        (F.col("c.domain") == F.col("i.domain")) & (F.col("c.month") == F.col("i.month")) & open_then,
        "left",
    )
    names = F.array_sort(F.collect_set("list_name"))
    return (
        met.groupBy(id_col, "url", "fetched_at", "host")
        .agg(names.alias("__names"))
        .select(
            id_col,
            "url",
            "fetched_at",
            "host",
            F.size("__names").cast("bigint").alias("n_lists"),
            F.array_join("__names", ",").alias("lists"),
            (F.size("__names") > 0).alias("blocked"),
        )
    )
