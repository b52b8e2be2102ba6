"""Compare registered queries with their SQL twins on one scale factor.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "HUGEINT": "hugeint",
         "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp", "TIMESTAMP_NS": "timestamp", "DATE": "date"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, "nan" if math.isnan(value) else repr(float(value) + 0.0))
    if isinstance(value, datetime.datetime):
        return (3, value.isoformat())
    return (4, str(value))


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    """Differences found; empty when schema and rows agree exactly."""
    df = query(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    types = [str(d[1]) for d in relation.description]
    want = relation.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns: {sorted(set(df.columns) ^ set(names))}"]
    kinds = {n: KINDS.get(t, t) for n, t in zip(names, types)}
    for name, kind in df.dtypes:
        if kinds[name] != kind.removesuffix("_ntz"):
            problems.append(f"type of {name}: {kind} / {kinds[name]}")
    a, b = canonical(df.columns, got), canonical(names, want)
    if len(a) != len(b):
        problems.append(f"rows: {len(a)} / {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(bad)} of {len(a)} rows differ")
        ordered = sorted(df.columns)
        for x, y in bad[:2]:
            problems.append(str([(n, p[1], q[1]) for n, p, q in zip(ordered, x, y) if p != q][:6]))
    return problems


def main(sf_dir: str, *only: str) -> int:
    import __spark_entry__ as entry
    from creditloom.session import build_session

    spark = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name, query in entry.queries().items():
        sql = entry.oracle_sql().get(name)
        if sql is None or (only and name not in only):
            continue
        start = time.time()
        try:
            problems = compare(spark, con, sf_dir, query, sql)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{name:28s} {'FAIL' if problems else 'ok':4s} {time.time() - start:6.2f}s", flush=True)
        for problem in problems:
            print("    ", problem)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
