"""Post identity and the post table.

A post row is matched by id, else by permalink, else it is new; a stored post never changes
its id or permalink. So which rows insert is decided by the distinct (id, permalink) pairs
alone: going through them by first appearance, a pair inserts when neither its id nor its
permalink was stored by an earlier inserting pair. That is greedy matching in order of
appearance, and it runs in parallel: every pair that comes first both for its id and for its
permalink inserts, and the pairs that share either with it drop out. What is left hangs
together in components of shared ids and permalinks; each is gone through on its own, in
order, one partition holding many of them. A component too large for that goes into the next
round, where it breaks up further.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.components import component_roots
from leadloom.operators.merge import first_value, last_value
from leadloom.session import stored

POST_FIRST = ("post_fb_id", "permalink", "source_group_id")
POST_LAST_NON_NULL = ("author", "author_fb_id", "timestamp_unix")
POST_LAST_NON_EMPTY = ("raw_text", "source_kind")

# Pairs of a component that one task goes through; it holds their ids and links as it goes.
FOLD_PAIRS = 200_000


def _spread_nulls(value: Column, by: Column) -> Column:
    """A join key that equals ``value``; nulls become scattered keys that match nothing.

    Outer and anti joins would send all null keys to one task.
    """
    return F.coalesce(value, F.concat(F.lit("\x01"), F.pmod(F.xxhash64(by), F.lit(4096)).cast("string")))


def _without(live: DataFrame, stored: DataFrame) -> DataFrame:
    """The pairs that share neither id nor link with a stored one."""
    return (
        live.withColumn("__id", _spread_nulls(F.col("id"), F.col("at")))
        .join(stored.select(F.col("id").alias("__id")).dropna(), "__id", "left_anti")
        .withColumn("__link", _spread_nulls(F.col("link"), F.col("at")))
        .join(stored.select(F.col("link").alias("__link")).dropna(), "__link", "left_anti")
        .select("id", "link", "at")
    )


def _first_of_both(live: DataFrame) -> DataFrame:
    """The pairs that come first both for their id and for their link."""
    first_of_id = live.dropna(subset=["id"]).groupBy("id").agg(F.min("at").alias("id_at"))
    first_of_link = live.dropna(subset=["link"]).groupBy("link").agg(F.min("at").alias("link_at"))
    ranked = (
        live.withColumn("__id", _spread_nulls(F.col("id"), F.col("at")))
        .join(first_of_id.withColumnRenamed("id", "__id"), "__id", "left")
        .withColumn("__link", _spread_nulls(F.col("link"), F.col("at")))
        .join(first_of_link.withColumnRenamed("link", "__link"), "__link", "left")
    )
    leads = (F.col("id").isNull() | (F.col("at") == F.col("id_at"))) & (
        F.col("link").isNull() | (F.col("at") == F.col("link_at"))
    )
    return ranked.filter(leads).select("id", "link", "at")


def _with_component(live: DataFrame) -> DataFrame:
    """``live`` plus ``component`` and its number of pairs, ``n``. Two values of one hash only make a component larger."""
    node = {
        kind: F.when(F.col(kind).isNotNull(), F.xxhash64(F.lit(kind), F.col(kind))) for kind in ("id", "link")
    }
    roots = component_roots(live.select(node["id"].alias("a"), node["link"].alias("b")).dropna())
    named = live.withColumn("node", F.coalesce(node["id"], node["link"])).join(roots, "node", "left")
    named = stored(named.select("id", "link", "at", F.coalesce("root", "node").alias("component")))
    return named.join(named.groupBy("component").agg(F.count("*").alias("n")), "component")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inserting pairs of components that follow each other, each in order."""
    component, ids, links = None, set(), set()
    for batch in batches:
        inserts = []
        for own, id_, link in zip(*(batch.column(c).to_pylist() for c in ("component", "id", "link"))):
            if own != component:
                component, ids, links = own, set(), set()
            new = id_ not in ids and link not in links
            if new and id_ is not None:
                ids.add(id_)
            if new and link is not None:
                links.add(link)
            inserts.append(new)
        yield batch.select(["id", "link", "at"]).filter(pa.array(inserts, pa.bool_()))


def inserting_pairs(
    rows: DataFrame, id_col: str = "post_fb_id", link_col: str = "permalink", seq: str = "seq",
    state: DataFrame | None = None, fold_pairs: int = FOLD_PAIRS,
) -> DataFrame:
    """``id, link, at``: the pairs that insert a post and the order key of the row that does it."""
    known = rows.select(
        F.nullif(F.col(id_col), F.lit("")).alias("id"), F.nullif(F.col(link_col), F.lit("")).alias("link"), seq
    ).filter(F.col("id").isNotNull() | F.col("link").isNotNull())
    live = known.groupBy("id", "link").agg(F.min(seq).alias("at"))
    if state is not None:
        live = _without(live, state.select(F.col(id_col).alias("id"), F.col(link_col).alias("link")))
    live = stored(live.select("id", "link", "at"))
    chosen = live.limit(0)
    while not live.isEmpty():
        new = stored(_first_of_both(live))
        chosen = chosen.unionByName(new)
        live = stored(_without(live, new))
        if live.isEmpty():
            break
        held = stored(_with_component(live))
        small = held.filter(F.col("n") <= fold_pairs).repartition("component").sortWithinPartitions("component", "at")
        folded = small.select("id", "link", "at", "component").mapInArrow(_greedy, live.schema)
        chosen = chosen.unionByName(stored(folded))
        live = held.filter(F.col("n") > fold_pairs).select("id", "link", "at")
    return chosen


def _pair_key(id_col: str, link_col: str) -> Column:
    return F.when(F.col(id_col).isNotNull(), F.sha2(F.concat(F.lit("id:"), F.col(id_col)), 256)).otherwise(
        F.sha2(F.concat(F.lit("link:"), F.col(link_col)), 256)
    )


def resolve_posts(
    rows: DataFrame, id_col: str = "post_fb_id", link_col: str = "permalink", seq: str = "seq",
    state: DataFrame | None = None,
) -> DataFrame:
    """``rows`` plus ``post_key`` and ``was_inserted``. Keys are hashes, the same in every run.

    A row follows its id when that was stored by then, else its permalink.
    """
    owners = inserting_pairs(rows, id_col, link_col, seq, state).withColumn("key", _pair_key("id", "link"))
    if state is not None:
        stored = state.select(F.col(id_col).alias("id"), F.col(link_col).alias("link"), F.col("post_key").alias("key"))
        owners = owners.unionByName(stored, allowMissingColumns=True)
    by_id = owners.dropna(subset=["id"]).select(
        F.col("id").alias("__id"), F.col("key").alias("__id_key"), F.col("at").alias("__id_at")
    )
    by_link = owners.dropna(subset=["link"]).select(
        F.col("link").alias("__link"), F.col("key").alias("__link_key"), F.col("at").alias("__link_at")
    )
    own_id, own_link = F.nullif(F.col(id_col), F.lit("")), F.nullif(F.col(link_col), F.lit(""))
    seen = rows.withColumns(
        {"__id": _spread_nulls(own_id, F.col(seq)), "__link": _spread_nulls(own_link, F.col(seq))}
    )
    matched = seen.join(by_id, "__id", "left").join(by_link, "__link", "left")
    order = F.col(seq)
    id_stored = F.col("__id_key").isNotNull() & (F.col("__id_at").isNull() | (F.col("__id_at") <= order))
    link_stored = F.col("__link_key").isNotNull() & (F.col("__link_at").isNull() | (F.col("__link_at") <= order))
    keyless = own_id.isNull() & own_link.isNull()
    own_key = F.sha2(F.concat(F.lit("row:"), F.coalesce(F.col("raw_text"), F.lit("")), order.cast("string")), 256)
    inserted = keyless | F.coalesce(F.col("__id_at") == order, F.col("__link_at") == order, F.lit(False))
    return matched.select(
        *rows.columns,
        F.when(keyless, own_key)
        .when(id_stored, F.col("__id_key"))
        .when(link_stored, F.col("__link_key"))
        .alias("post_key"),
        inserted.alias("was_inserted"),
    )


def merge_posts(rows: DataFrame, state: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """The post table after upserting ``rows`` in order; ``rows`` has seen_at."""
    order = F.col(seq)
    keyed = resolve_posts(rows, seq=seq, state=state).withColumns(
        {"first_seen": F.col("seen_at"), "last_seen": F.col("seen_at")}
    )
    if state is not None:
        keyed = keyed.unionByName(state, allowMissingColumns=True)
        before = F.struct(F.col(seq).isNotNull(), F.col(seq))
        keyed = keyed.withColumn("__order", before)
    else:
        keyed = keyed.withColumn("__order", F.struct(F.lit(True), order))
    at = F.col("__order")
    folded = keyed.groupBy("post_key").agg(
        first_value(F.struct(*POST_FIRST), at).alias("__first"),
        *[last_value(F.col(c), at, F.col(c).isNotNull()).alias(c) for c in POST_LAST_NON_NULL],
        *[
            F.coalesce(last_value(F.col(c), at, F.col(c) != ""), first_value(F.col(c), at)).alias(c)
            for c in POST_LAST_NON_EMPTY
        ],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return folded.select(
        "post_key",
        *[F.col("__first")[c].alias(c) for c in POST_FIRST],
        *POST_LAST_NON_NULL,
        *POST_LAST_NON_EMPTY,
        "first_seen",
        "last_seen",
    )
