"""Run queries beside their SQL twins: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal; else what differs."""
    names = sorted(spark_df.columns)
    mine = [tuple(plain(r[c]) for c in names) for r in spark_df.collect()]
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    if sorted(cols) != names:
        return f"columns {names} / {sorted(cols)}"
    at = [cols.index(c) for c in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    mine.sort(key=repr)
    theirs.sort(key=repr)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows, e.g. {names}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from leadloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            said = difference(df, con, sql[name]) if name in sql else f"no twin, {df.count()} rows"
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            said = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(said and not said.startswith("no twin"))
        print(f"{'ok  ' if said is None else 'DIFF'} {name} {time.time() - start:.1f}s {said or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
