"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value) -> str:
    return type(value).__name__


def compare(columns_a, rows_a, columns_b, rows_b) -> str | None:
    """None when equal, else what differs."""
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(columns_a)} != {sorted(columns_b)}"
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} != {len(rows_b)}"
    order = sorted(columns_a)
    pick = lambda cols, rows: sorted(
        (tuple(_plain(r[cols.index(c)]) for c in order) for r in rows), key=repr
    )
    a, b = pick(list(columns_a), rows_a), pick(list(columns_b), rows_b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {order}: {bad[0][0]} != {bad[0][1]}"
    kinds = [(x, y) for r, q in zip(a[:200], b[:200], strict=True) for x, y in zip(r, q, strict=True) if _kind(x) != _kind(y)]
    return f"types differ: {kinds[0]}" if kinds else None


def _type_family(name: str) -> str:
    name = name.lower()
    for family, words in {
        "bigint": ("bigint", "long", "int64"),
        "integer": ("integer", "int"),
        "double": ("double",),
        "string": ("varchar", "string"),
    }.items():
        if name in words:
            return family
    return name


def check(spark: SparkSession, con, run, sql: str | None, sf_dir: str) -> tuple[str | None, int, float, float]:
    start = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return f"plan has a {bad}", len(rows), spent, 0.0
    if sql is None:
        return None, len(rows), spent, 0.0
    start = time.time()
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = {d[0]: _type_family(str(d[1])) for d in got.description}
    expected = got.fetchall()
    result = compare(df.columns, rows, names, expected)
    if result is None:
        mine = {f.name: _type_family(f.dataType.simpleString()) for f in df.schema.fields}
        off = {c: (mine[c], kinds[c]) for c in mine if mine[c] != kinds[c] and not mine[c].startswith("array")}
        result = f"schema differs: {off}" if off else None
    return result, len(rows), spent, time.time() - start


def main() -> None:
    from regionflow.plans.catalog import catalog
    from regionflow.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8, {"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, q in catalog().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, spent, sql_spent = check(spark, con, q.run, q.sql, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, n, spent, sql_spent = f"{type(error).__name__}: {str(error)[:600]}", -1, 0, 0
        failed += problem is not None
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name:28s} rows={n:7d} spark={spent:6.2f}s sql={sql_spent:6.2f}s {'' if q.sql else '(no sql) '}{problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
