"""State tables as sets of files that one manifest names together.

A change of several tables writes new files first and then one row set of the manifest, ``{root}/manifest/v=N``. Readers
follow the newest manifest, so they see the tables of one change or those of the change before, never a mixture, and what
an interrupted change wrote is named by nothing. Tables with a key are cut into hash buckets, each with files of its own;
a change writes the buckets it touches and names the former files of the others. All of it is plain reading and writing
of Parquet, on any file system that Spark knows.

Two changes that start from the same version both write ``v=N``. Each reads its manifest back; the one whose id sorts
first stands, the other raises ``Conflict`` and can be tried again. Between those two writes a reader may follow the one
that loses, so writers that must never be seen in vain take turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import schemas
from leadloom.sources.sinks import append_runs

_MANIFEST = "change string, name string, bucket int, path string, buckets int, stream string, batch bigint"
#: The file set of a table without a key, and of a keyed one before its first row.
WHOLE = -1


class Conflict(RuntimeError):
    """Another change took this version first."""


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables: for each table its buckets' paths. Version -1 is the empty state."""

    version: int = -1
    paths: dict[str, dict[int, str]] = field(default_factory=dict)
    buckets: int | None = None


@dataclass(frozen=True)
class Tables:
    """The state tables under one root folder. ``buckets`` counts for a new root; an older one keeps its own number.

    A bucket is written by one task: choose as many as keep a bucket's rows in one task's memory.
    """

    spark: SparkSession
    root: str
    buckets: int = 32

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _stored(self, name: str, schema: str, first: str = "") -> DataFrame:
        """The rows of a folder; one that isn't there yet is begun without rows, in its part ``first``."""
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(self.folder(name) + first)
        return self.spark.read.schema(f"{schema}, v bigint").parquet(self.folder(name))

    def _manifests(self) -> DataFrame:
        """The rows of all changes that stand."""
        rows = self._stored("manifest", _MANIFEST, "/v=-1")
        stand = rows.groupBy("v").agg(F.min("change").alias("change"))
        return rows.join(stand, ["v", "change"])

    def versions(self) -> list[int]:
        """The versions that can still be read, oldest first."""
        made = {r["v"] for r in self._stored("manifest", _MANIFEST, "/v=-1").select("v").distinct().collect()}
        return sorted(made - {r["v"] for r in self._stored("vacuumed", "at timestamp").collect()})

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one named. A version has a row per table and bucket, whatever the data."""
        found = self.versions()
        version = version if version is not None else found[-1] if found else -1
        if version not in found:
            return Snapshot()
        paths: dict[str, dict[int, str]] = {}
        buckets = None
        for row in self._manifests().filter(F.col("v") == version).collect():
            if row["path"] is not None:
                paths.setdefault(row["name"], {})[row["bucket"]] = row["path"]
            buckets = row["buckets"]
        return Snapshot(version, paths, buckets)

    def read(self, name: str, schema: T.StructType, version: int | None = None) -> DataFrame | None:
        """A table of the newest version or the one named; None when it has none."""
        return self.read_from(self.snapshot(version), name, schema)

    def read_from(
        self, snapshot: Snapshot, name: str, schema: T.StructType, buckets: Sequence[int] | None = None
    ) -> DataFrame | None:
        """A table of a snapshot, of the named buckets only if there are some; None when nothing is stored."""
        held = snapshot.paths.get(name, {})
        paths = [self.folder(path) for bucket, path in sorted(held.items()) if buckets is None or bucket in buckets]
        return schemas.evolve(self.spark.read.schema(schema).parquet(*paths), schema) if paths else None

    def change(self) -> Change:
        base = self.snapshot()
        return Change(self, base, base.buckets or self.buckets)

    def has_folded(self, stream: str, batch: int) -> bool:
        """Is this batch of this stream part of a change that stands?"""
        own = (F.col("stream") == stream) & (F.col("batch") == batch)
        return not self._manifests().filter(own).isEmpty()

    def vacuum(self, keep: int = 2) -> list[int]:
        """Empty the files that only versions before the newest ``keep`` name; returns those versions.

        The manifests stay, with the ledger of folded batches in them. Inputs that a change wrote beside its tables are
        emptied with it.
        """
        found = self.versions()
        old, kept = found[: -max(keep, 1)], found[-max(keep, 1) :]
        rows = self._manifests().filter(F.col("path").isNotNull())
        named = rows.groupBy("path").agg(F.max("v").alias("last")).filter(F.col("last") < (kept or [0])[0])
        done = {r["v"] for r in self._stored("vacuumed", "at timestamp").collect()}
        nothing = self.spark.createDataFrame([], "gone int")
        for row in named.filter(~F.col("last").isin(sorted(done))).toLocalIterator():
            nothing.write.mode("overwrite").parquet(self.folder(row["path"]))
        if old:
            gone = self.spark.createDataFrame([(v,) for v in old], "v bigint").withColumn("at", F.current_timestamp())
            gone.coalesce(1).write.mode("append").parquet(self.folder("vacuumed"))
        return old

    def runs(self) -> DataFrame:
        return schemas.evolve(self.spark.read.parquet(self.folder("runs")), schemas.RUNS)

    def add_run(self, **fields) -> None:
        """Append one run record; it names counts, not data."""
        one = {f.name: fields.get(f.name) for f in schemas.RUNS.fields}
        append_runs(self.spark.createDataFrame([tuple(one.values())], schemas.RUNS), self.folder("runs"))


class Change:
    """The next version of some tables; nobody sees any of it before ``commit``."""

    def __init__(self, tables: Tables, base: Snapshot, buckets: int):
        self.tables, self.base, self.buckets = tables, base, buckets
        self.version, self.id = base.version + 1, uuid.uuid4().hex
        self._paths = {name: dict(held) for name, held in base.paths.items()}

    def read(self, name: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """A table as it was before the change."""
        return self.tables.read_from(self.base, name, schema, buckets)

    def _write(self, name: str, df: DataFrame, by: Sequence[str] = (), **counts: Column) -> tuple[str, dict[str, int]]:
        """The new files' path and what the write itself counts: the rows, ``n``, and more counts by name."""
        path, seen = f"{name}/{self.id}", Observation()
        metrics = [c.alias(k) for k, c in {"n": F.count(F.lit(1)), **counts}.items()]
        df.observe(seen, *metrics).write.partitionBy(*by).parquet(self.tables.folder(path))
        return path, seen.get

    def replace(self, name: str, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """Write a whole table; returns it as written, and its number of rows ``n`` with the other counts."""
        path, seen = self._write(name, df, **counts)
        self._paths[name] = {WHOLE: path}
        return self.tables.spark.read.schema(df.schema).parquet(self.tables.folder(path)), seen

    def bucket(self, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *key: str | Column) -> list[int]:
        """The buckets that hold these keys; at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(*key)).distinct().collect())

    def replace_buckets(
        self, name: str, df: DataFrame, schema: T.StructType, key: Sequence[str], touched: Sequence[int]
    ) -> int:
        """Write the touched buckets of a table, ``df`` holds all their rows; the others keep their files. Returns the rows."""
        held = self._paths.setdefault(name, {})
        if not held:
            nothing = self.tables.spark.createDataFrame([], schema)
            path = f"{name}/{self.id}-none"
            nothing.write.parquet(self.tables.folder(path))
            held[WHOLE] = path
        if not touched:
            return 0
        cut = schemas.evolve(df, schema).withColumn("bucket", self.bucket(*key))
        path, seen = self._write(name, cut.repartition(len(touched), "bucket"), ["bucket"])
        held |= {b: f"{path}/bucket={b}" for b in touched}
        return seen["n"]

    def commit(self, stream: str | None = None, batch: int | None = None) -> int:
        """Make the change the newest version, with the stream's batch it folds; ``Conflict`` if another came first."""
        rows = [(self.id, name, b, path, self.buckets, stream, batch) for name, held in self._paths.items() for b, path in held.items()]
        rows = rows or [(self.id, None, None, None, self.buckets, stream, batch)]
        spark, folder = self.tables.spark, self.tables.folder("manifest")
        if self.version in self.tables.versions():
            raise Conflict(f"version {self.version} was made by another change")
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/v={self.version}")
        first = spark.read.schema(_MANIFEST).parquet(f"{folder}/v={self.version}").agg(F.min("change")).first()[0]
        if first != self.id:
            raise Conflict(f"version {self.version} was made by another change")
        return self.version
