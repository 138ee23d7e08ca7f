"""Keyed merges: ordered folds of sightings into one row per key.

All scalar rules are aggregates with map-side combine, so a key that holds a third of all
rows shrinks before the shuffle. Lists stay in long form (one row per key and value) until
a caller asks for arrays. The raw-text fold is sequential per key; keys with many rows are
folded over sorted range partitions that carry one state (see ``fold_over_ranges``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from leadloom import vocab
from leadloom.functions import text as tx
from leadloom.operators.ranking import range_sorted
from leadloom.session import broadcast_if_few, cut_lineage

LAST_NON_EMPTY = ("phone_raw", "name", "what", "why")
LAST = ("intent", "intent_confidence", "intent_matched_keywords", "intent_raw_excerpt", "source_group_id")
LAST_NON_NULL = ("author", "timestamp_unix", "permalink", "reactions_count", "comments_count")

# A key beyond either bound has its texts folded over range partitions instead of in one array.
FOLD_ROWS = 4_096
FOLD_CHARS = 8_000_000


def last_value(value: Column, seq: Column, where: Column | None = None) -> Column:
    """The value of the last row in ``seq`` order, among the rows where ``where`` holds.

    Rows that do not count get no order key, and such rows are ignored.
    """
    return F.max_by(value, seq if where is None else F.when(where, seq))


def first_value(value: Column, seq: Column, where: Column | None = None) -> Column:
    return F.min_by(value, seq if where is None else F.when(where, seq))


def fold_scalars(
    rows: DataFrame,
    key: str = "phone_normalized",
    seq: str = "seq",
    *,
    last_non_empty: Sequence[str] = LAST_NON_EMPTY,
    last: Sequence[str] = LAST,
    last_non_null: Sequence[str] = LAST_NON_NULL,
) -> DataFrame:
    """One row per key. ``rows`` has first_seen, last_seen and post_count; a sighting counts one.

    Folding already folded rows again is the same as folding all sightings at once, so state
    and batch simply go in together.
    """
    order = F.col(seq)
    newest = last_value(F.struct(*last), order)
    aggregates = [
        *[
            F.coalesce(last_value(F.col(c), order, F.col(c) != ""), first_value(F.col(c), order)).alias(c)
            for c in last_non_empty
        ],
        newest.alias("__newest"),
        *[last_value(F.col(c), order, F.col(c).isNotNull()).alias(c) for c in last_non_null],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("post_count").alias("post_count"),
    ]
    folded = rows.groupBy(key).agg(*aggregates)
    return folded.select(
        key,
        *last_non_empty,
        *[F.col("__newest")[c].alias(c) for c in last],
        "first_seen",
        "last_seen",
        "post_count",
        *last_non_null,
    )


def distinct_links(
    rows: DataFrame,
    key: str = "phone_normalized",
    seq: str = "seq",
    links: str = "links",
    state: DataFrame | None = None,
) -> DataFrame:
    """``key, link, first_at``: the ordered distinct union of the link lists, one row per link.

    ``first_at`` orders the links of a key; links of the ``state`` (same shape) keep theirs.
    The grouping is by key *and* link, so a hot key spreads over all tasks.
    """
    listed = rows.select(key, F.col(seq).alias("__seq"), F.posexplode(links).alias("__pos", "link"))
    found = listed.filter(tx.collapse_spaces(F.col("link")) != "").select(
        key, "link", F.struct(F.col("__seq").alias("seq"), F.col("__pos").alias("pos")).alias("first_at")
    )
    if state is not None:
        found = found.unionByName(state)
    return found.groupBy(key, "link").agg(F.min("first_at").alias("first_at"))


def with_link_lists(leads: DataFrame, links: DataFrame, key: str = "phone_normalized") -> DataFrame:
    """Leads with their links as one ordered array, for sinks that need a list in a cell.

    Only the links of the given leads are collected; tables keep links in the long form.
    """
    listed = links.join(leads.select(key), key, "left_semi")
    pairs = F.array_sort(F.collect_list(F.struct("first_at", "link")))
    lists = listed.groupBy(key).agg(pairs.alias("p")).select(key, F.transform("p", lambda p: p["link"]).alias("links"))
    return leads.join(lists, key, "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


# ---- raw text ---------------------------------------------------------------------


def append_text(existing: Column, new: Column, cap: int = vocab.RAW_TEXT_CAP) -> Column:
    """One step: the first text as it is; a known one adds nothing; else append; keep the tail."""
    merged = F.when(F.contains(existing, new), existing).otherwise(
        F.concat(existing, F.lit(vocab.RAW_TEXT_SEPARATOR), new)
    )
    return (
        F.when(existing.isNull(), new)
        .when(existing == "", F.right(new, F.lit(cap)))
        .otherwise(F.right(merged, F.lit(cap)))
    )


def _fold_array(initial: Column, texts: Column, cap: int) -> Column:
    return F.aggregate(texts, initial.cast("string"), lambda acc, t: append_text(acc, t, cap))


def fold_raw_text(
    rows: DataFrame,
    key: str = "phone_normalized",
    seq: str = "seq",
    text: str = "raw_text",
    *,
    state: DataFrame | None = None,
    cap: int = vocab.RAW_TEXT_CAP,
    max_rows: int = FOLD_ROWS,
    max_chars: int = FOLD_CHARS,
) -> DataFrame:
    """``key, raw_text``: the texts of each key folded in ``seq`` order, starting from ``state``.

    Every step looks at the text so far, so the fold of one key is sequential. Three ways
    lead to the same result, by the size of the key:

    * within the bounds: one array per key;
    * larger, but its distinct texts fit under ``cap`` together (copies): nothing is ever cut
      off, so only first occurrences matter, and these are found by a grouping on key and text;
    * larger still: sorted range partitions, see ``fold_over_ranges``.
    """
    source = rows.select(key, F.col(seq).alias("__seq"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    sizes = source.groupBy(key).agg(F.count("*").alias("__n"), F.sum(F.length("__text")).alias("__chars"))
    hot = cut_lineage(sizes.filter((F.col("__n") > max_rows) | (F.col("__chars") > max_chars)))
    initial = None if state is None else state.select(key, F.col(text).alias("__initial"))
    if hot.isEmpty():
        return _fold_arrays(source, key, initial, cap, text)

    hot_keys = broadcast_if_few(hot.select(key))
    small = source.join(hot_keys, key, "left_anti")
    firsts = cut_lineage(
        source.join(hot_keys, key, "left_semi").groupBy(key, "__text").agg(F.min("__seq").alias("__seq"))
    )
    room = firsts.groupBy(key).agg(
        F.sum(F.length("__text") + len(vocab.RAW_TEXT_SEPARATOR)).alias("__distinct")
    )
    room = hot.join(room, key)
    if initial is not None:
        room = room.join(initial, key, "left").withColumn(
            "__distinct", F.col("__distinct") + F.coalesce(F.length("__initial"), F.lit(0))
        )
    room = cut_lineage(room.withColumn("__fits", F.col("__distinct") <= cap))
    copies = firsts.join(room.filter("__fits").select(key), key, "left_semi")
    folded = _fold_arrays(small, key, initial, cap, text).unionByName(_fold_arrays(copies, key, initial, cap, text))
    beyond = room.filter(~F.col("__fits")).select(key)
    if beyond.isEmpty():
        return folded
    beyond = broadcast_if_few(beyond)
    large = source.join(beyond, key, "left_semi")
    stored = None if initial is None else initial.join(beyond, key, "left_semi")
    return folded.unionByName(fold_over_ranges(large, key, stored, cap, text)[0])


def _ordered_texts() -> Column:
    pairs = F.array_sort(F.collect_list(F.struct("__seq", "__text")))
    return F.transform(pairs, lambda r: r["__text"])


def _fold_arrays(source: DataFrame, key: str, initial: DataFrame | None, cap: int, text: str) -> DataFrame:
    grouped, start = source.groupBy(key).agg(_ordered_texts().alias("__texts")), F.lit(None)
    if initial is not None:
        grouped, start = grouped.join(initial, key, "left"), F.col("__initial")
    return grouped.select(key, _fold_array(start, F.col("__texts"), cap).alias(text))


def append_str(existing: str | None, new: str, cap: int) -> str:
    """``append_text`` on plain strings, for code that runs inside tasks."""
    if existing is None:
        return new
    if existing == "":
        return new[-cap:]
    return existing[-cap:] if new in existing else (existing + vocab.RAW_TEXT_SEPARATOR + new)[-cap:]


def _fold_runs(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """One sorted partition to one row per key: ``key, __part, __first, __end``; memory is one text and one state.

    A key that began in an earlier partition folds from an empty text for now.
    """
    key = part = state = None
    first = started = False
    for batch in batches:
        done = []
        for k, p, row, text, stored, continued in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or k != key:
                if started:
                    done.append((key, part, first, state))
                key, part, first, started = k, p, row == 0, True
                state = "" if continued else None
            state = text if stored else append_str(state, text, cap)
        if done:
            yield _run_rows(done, batch.schema.field(0).type)
        key_type = batch.schema.field(0).type
    if started:
        yield _run_rows([(key, part, first, state)], key_type)


def _run_rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = (key_type, pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "part", "first", "end"])


def _refold_run(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """The first key of one partition, folded from its right start beside the former one: ``__part, __met, __end``.

    Where both states meet, the rest is known: the former end holds (``__met``) and no later row is folded.
    """
    part = old = new = None
    met = started = False
    for batch in batches:
        if met:
            continue
        for p, text, former, given, begins in zip(*(c.to_pylist() for c in batch.columns)):
            if begins:
                part, old, new, started = p, former, given, True
            old, new = append_str(old, text, cap), append_str(new, text, cap)
            if old == new:
                met = True
                break
    if started:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([met]), pa.array([None if met else new], pa.string())],
            names=["part", "met", "end"],
        )


def fold_over_ranges(
    source: DataFrame, key: str, stored: DataFrame | None, cap: int, text: str
) -> tuple[DataFrame, int]:
    """Fold keys of any size: ``key, raw_text``, and the number of rounds after the first.

    ``source``: key, ``__seq``, ``__text``; ``stored``: key, ``__initial``. The rows are range-partitioned and sorted once. Each
    partition is folded as a stream that carries one state, and only its first key may go on from the partition before.
    Such a run folds from a guess, then takes the end of the run before it; runs whose start was wrong fold again, side by
    side with their former fold, and stop where the two states meet. A state forgets its start after ``cap`` characters of
    new text, so that is soon. Each round settles at least one more partition of each key, so there are at most as many
    rounds as partitions, however many rows a key has. Between rounds only one row a partition is moved.
    """
    rows = source.select(key, F.lit(False).alias("__stored"), "__seq", "__text")
    if stored is not None:
        first = stored.dropna(subset=["__initial"]).select(key, F.lit(True).alias("__stored"), F.col("__initial").alias("__text"))
        rows = first.unionByName(rows, allowMissingColumns=True)
    placed = range_sorted(rows.select(key, "__stored", "__seq", "__text"), [key], [F.desc("__stored"), "__seq"])
    # One row a partition: at most spark.sql.shuffle.partitions, so these tables are small enough for broadcasts.
    edges = placed.groupBy("__part").agg(
        F.min_by(key, "__row").alias("__first_key"), F.max_by(key, "__row").alias("__last_key")
    )
    before = W.orderBy("__part")
    edges = edges.withColumns({"__before": F.lag("__part").over(before), "__goes_on": F.lag("__last_key").over(before)})
    edges = cut_lineage(edges.withColumn("__goes_on", F.col("__before").isNotNull() & F.col("__goes_on").eqNullSafe(F.col("__first_key"))))
    goes_on = edges.filter("__goes_on").select("__part", F.lit(0).cast("bigint").alias("__row"), F.lit(True).alias("__on"))
    marked = placed.join(F.broadcast(goes_on), ["__part", "__row"], "left")
    key_type = source.schema[key].dataType.simpleString()
    runs = cut_lineage(
        marked.select(key, F.col("__part").cast("bigint"), "__row", "__text", "__stored", F.coalesce("__on", F.lit(False))).mapInArrow(
            partial(_fold_runs, cap=cap), f"`{key}` {key_type}, __part bigint, __first boolean, __end string"
        )
    )
    # What a partition takes in and hands on: the end of its first run, and that of its last one.
    first_ends = runs.filter("__first").select("__part", F.col("__end").alias("__first_end"))
    last_ends = runs.join(F.broadcast(edges.select("__part", F.col("__last_key").alias(key))), ["__part", key], "left_semi")
    known = cut_lineage(
        edges.join(first_ends, "__part")
        .join(last_ends.select("__part", F.col("__end").alias("__last_end")), "__part")
        .withColumns({"__start": F.lit(""), "__one": F.col("__first_key").eqNullSafe(F.col("__last_key"))})
    )
    rounds = 0
    while True:
        handed = known.select(F.col("__part").alias("__before"), F.col("__last_end").alias("__given"))
        wrong = cut_lineage(
            known.filter("__goes_on").join(handed, "__before").filter("__given <> __start").select("__part", "__first_key", "__start", "__given")
        )
        if wrong.isEmpty():
            break
        rounds += 1
        starts = wrong.select("__part", F.lit(0).cast("bigint").alias("__row"), "__start", "__given", F.lit(True).alias("__begins"))
        again = (
            placed.join(F.broadcast(wrong.select("__part", F.col("__first_key").alias(key))), ["__part", key], "left_semi")
            .join(F.broadcast(starts), ["__part", "__row"], "left")
            .select(F.col("__part").cast("bigint"), "__text", "__start", "__given", F.coalesce("__begins", F.lit(False)))
            .mapInArrow(partial(_refold_run, cap=cap), "__part bigint, __met boolean, __new string")
        )
        given = wrong.select("__part", "__given")
        known = cut_lineage(
            known.join(again, "__part", "left").join(given, "__part", "left").withColumn("__first_end", F.coalesce("__new", "__first_end"))
            .withColumns({"__start": F.coalesce("__given", "__start"), "__last_end": F.when(F.col("__one"), F.col("__first_end")).otherwise(F.col("__last_end"))})
            .select(*known.columns)
        )
    # A run that goes on in the next partition isn't its key's last one.
    unfinished = known.filter("__goes_on").select(F.col("__before").alias("__part"), F.col("__first_key").alias(key))
    settled = known.select("__part", F.col("__first_key").alias(key), "__first_end")
    ends = (
        runs.join(F.broadcast(unfinished), ["__part", key], "left_anti")
        .join(F.broadcast(settled), ["__part", key], "left")
        .select(key, F.coalesce("__first_end", "__end").alias(text))
    )
    return ends, rounds


# ---- leads ------------------------------------------------------------------------


def as_fold_rows(found: DataFrame) -> DataFrame:
    """Sightings in the shape of the fold: each is its own first and last and counts one."""
    return found.withColumns(
        {"first_seen": F.col("seen_at"), "last_seen": F.col("seen_at"), "post_count": F.lit(1).cast("bigint")}
    ).drop("seen_at")


def before_all(seq_type: T.StructType) -> Column:
    """An order key below every sighting's: negative batch, the rest zero."""
    values = [F.lit(-1 if i == 0 else 0).cast(f.dataType).alias(f.name) for i, f in enumerate(seq_type.fields)]
    return F.struct(*values)


def merge_leads(found: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Fold sightings into the lead table, starting from ``state``: one row per phone.

    The links are a table of their own, ``distinct_links``. ``found`` should be a written
    table or checkpoint: scalars and texts each read it.
    """
    key = "phone_normalized"
    rows = as_fold_rows(found).drop("links")
    if state is not None:
        rows = rows.unionByName(state.withColumn("seq", before_all(found.schema["seq"].dataType)), True)
    texts = fold_raw_text(found, state=state)
    if state is not None:
        untouched = state.select(key, F.col("raw_text").alias("__old"))
        texts = untouched.join(texts, key, "full").select(key, F.coalesce("raw_text", "__old").alias("raw_text"))
    return fold_scalars(rows).join(texts, key, "left")


def upsert_counts(found: DataFrame, state: DataFrame | None = None, key: str = "phone_normalized") -> DataFrame:
    """``inserted, duplicates``: keys that were not in the state, and all other sightings."""
    per_key = found.groupBy(key).agg(F.count("*").alias("n"))
    if state is None:
        known = F.lit(0)
    else:
        per_key = per_key.join(state.select(key, F.lit(1).alias("__known")), key, "left")
        known = F.coalesce("__known", F.lit(0))
    return (
        per_key.agg(F.sum(F.lit(1) - known).alias("inserted"), F.sum("n").alias("rows"))
        .select(
            F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted"),
            (F.coalesce("rows", F.lit(0)) - F.coalesce("inserted", F.lit(0))).cast("bigint").alias("duplicates"),
        )
    )


# ---- comments ---------------------------------------------------------------------


def first_per_id(rows: DataFrame, id_col: str, seq: str, state: DataFrame | None = None) -> DataFrame:
    """The first row of each id; rows without an id all stay; ids in the state are known already."""
    known_id = F.col(id_col).isNotNull() & (F.col(id_col) != "")
    payload = [c for c in rows.columns if c != id_col]
    firsts = (
        rows.filter(known_id)
        .groupBy(id_col)
        .agg(F.min_by(F.struct(*payload), F.col(seq)).alias("__row"))
        .select(id_col, *[F.col("__row")[c].alias(c) for c in payload])
    )
    if state is not None:
        firsts = firsts.join(state.select(id_col).filter(known_id).distinct(), id_col, "left_anti")
    return firsts.select(*rows.columns).unionByName(rows.filter(~F.coalesce(known_id, F.lit(False))))
