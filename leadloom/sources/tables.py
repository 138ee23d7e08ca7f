"""Table reads and JSON post files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leadloom import schemas

# Inputs below this size may arrive as a single row group; spreading them costs little.
SPREAD_BELOW_BYTES = 64 * 1024 * 1024


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table; with a schema, older files are brought into it (added columns null)."""
    df = spark.read.option("mergeSchema", "true" if schema else "false").parquet(path)
    return df if schema is None else schemas.evolve(df, schema)


# Rows that are parsed as markup take far longer than to read or move them; a task gets so many short blocks or whole pages.
BLOCKS_A_TASK, PAGES_A_TASK = 100_000, 2_000


def spread(df: DataFrame, task_rows: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Use all cores for a small input that would be read by one task.

    Large inputs bring enough splits of their own and pass through without a shuffle; with ``task_rows`` they are cut into
    tasks of that many rows, so that no task grows with the input. Bytes wouldn't do for that: rows that resemble each other
    may take hardly any. ``n_rows``: their number, where it is known; else they are counted (of Parquet, by the footers).
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores if size < SPREAD_BELOW_BYTES else 0
    if task_rows:
        tasks = max(cores, -(-(df.count() if n_rows is None else n_rows) // task_rows))
    return df.repartition(tasks) if tasks > 1 else df


def read_post_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON post files, one object per file, with their expected results."""
    return spark.read.schema(schemas.POST_FILES).json(path, multiLine=True)
