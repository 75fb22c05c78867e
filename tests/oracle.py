"""Run registered queries and their SQL side by side: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return value.item()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    start = time.time()
    df = query(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows-only {name} {len(left)} rows {spent:.1f}s"
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    oracle = time.time() - start
    if sorted(df.columns) != sorted(names):
        return f"FAIL {name} columns {sorted(df.columns)} vs {sorted(names)}"
    if left != right:
        known, seen = set(right), set(left)
        extra = [r for r in left if r not in known][:3]
        missing = [r for r in right if r not in seen][:3]
        return f"FAIL {name} {len(left)} vs {len(right)} rows\n  spark {extra}\n  sql   {missing}"
    return f"ok {name} {len(left)} rows {spent:.1f}s (sql {oracle:.1f}s)"


def main() -> int:
    from catalog import all_queries, all_sql
    from millrace.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = all_sql()
    failed = 0
    for name, query in all_queries().items():
        if chosen and name not in chosen:
            continue
        try:
            line = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            line = f"FAIL {name} {type(error).__name__}: {str(error)[:600]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
