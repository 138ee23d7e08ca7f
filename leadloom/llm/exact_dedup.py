"""Exact dedup: copies are combined locally, then in salted digest groups, then across salts.

Every stage groups by the digest *and* the whole normalised text, so a digest collision never merges two texts.

Only texts whose digest occurs more than once travel beyond the first shuffle; a text with a digest of its own has no
copy. A group of copies that holds a third of all rows is combined inside each task first, meets in ``SALTS`` places,
and sends one row from each to the last stage. The joins that tell each row its group are plain equi-joins, whose hot
side AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import keep, whole_text

SALTS = 32
#: Fixed value: each run of these bytes counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(whole_text(text), WHITE_SPACE, " ")


def _repeated(rows: DataFrame) -> DataFrame:
    """The digests of more than one row, as a table of its own: only so can the join with it split a hot digest.

    It grows with the data, so the join is a merge join at every size.
    """
    counted = rows.groupBy("__digest").agg(F.count("*").alias("__n")).where("__n > 1")
    return keep(counted.select("__digest", F.lit(True).alias("__again")), "repeated-digests").hint("merge")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal normalised texts the smallest id stays; ``group_size`` counts the rows with that text. Null texts equal
    empty ones. A null id comes after all others; a group of null ids only has a null ``keep_id`` and is kept. Rows
    repeated with the same id and text carry the same verdict. Empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__text")).withColumn(
        "__digest", F.sha2(F.col("__text"), 256)
    )
    repeated = _repeated(rows)
    told = rows.join(repeated, "__digest", "left").select(
        "__id", "__digest", F.when(F.col("__again"), F.col("__text")).alias("__text")
    )
    told = keep(told, "exact-dedup")
    candidates = told.where(F.col("__text").isNotNull())
    salt = F.pmod(F.xxhash64("__id"), F.lit(salts))
    salted = candidates.groupBy(salt.alias("__salt"), "__digest", "__text").agg(
        F.min("__id").alias("__id"), F.count("*").alias("__n")
    )
    winners = salted.groupBy("__digest", "__text").agg(F.min("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
    winners = keep(winners, "winners").hint("merge")
    copies = candidates.join(winners, ["__digest", "__text"]).select("__id", "keep_id", "group_size", "__digest")
    alone = told.where(F.col("__text").isNull()).select(
        "__id", F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "__digest"
    )
    return copies.unionByName(alone).select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, all columns: of each group of equal texts one row with the smallest id.

    Rows that repeat id and text come down to one, the least in the order of the other columns' JSON form.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in (id_col, text_col)]
    row = F.struct(
        F.col(id_col).isNull().alias("last"),
        F.col(id_col).alias("id"),
        F.to_json(F.struct(*[F.col(c) for c in rest])).alias("order") if rest else F.lit("").alias("order"),
        F.struct(*[F.col(c) for c in columns if c != text_col]).alias("row"),
        F.col(text_col).alias("text"),
    )
    rows = docs.select(row.alias("__row"), F.sha2(normalised(text_col), 256).alias("__digest"))
    repeated = _repeated(rows)
    told = keep(
        rows.join(repeated, "__digest", "left").select(
            "__digest", "__row", F.when(F.col("__again"), normalised(F.col("__row.text"))).alias("__text")
        ),
        "drop-copies",
    )
    salt = F.pmod(F.xxhash64(F.col("__row.id")), F.lit(salts))
    salted = (
        told.where(F.col("__text").isNotNull())
        .groupBy(salt.alias("__salt"), "__digest", "__text")
        .agg(F.min("__row").alias("__row"))
    )
    winners = salted.groupBy("__digest", "__text").agg(F.min("__row").alias("__row")).select("__row")
    kept = told.where(F.col("__text").isNull()).select("__row").unionByName(winners)
    return kept.select(*[(F.col("__row.text") if c == text_col else F.col("__row.row").getField(c)).alias(c) for c in columns])
