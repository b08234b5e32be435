"""Runs registered queries against their SQL in DuckDB and compares whole results.

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPE_OF = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    return "NULL" if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    expected_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for name, kind in df.dtypes:
        if TYPE_OF.get(kind) != expected_types[name]:
            return False, f"type of {name}: {kind} != {expected_types[name]}"
    mine = _rows(df.columns, got)
    theirs = _rows(rel.columns, rel.fetchall())
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}"
    if mine == theirs:
        return len(mine) > 0, f"{len(mine)} rows"
    left, right = set(mine), set(theirs)
    a, b = sorted(left - right), sorted(right - left)
    return False, f"{len(a)} of {len(mine)} rows differ: {sorted(df.columns)} {a[:2]} != {b[:2]}"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def main() -> int:
    import __spark_entry__ as entry

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # report every query, not just the first bad one
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
