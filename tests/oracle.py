"""Compare registered queries with their SQL twins: columns, row count and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.date):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, folder, query, sql):
    """None when equal, else a short description of the difference."""
    df = query(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    theirs = theirs.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        return None
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} / {len(b)}; spark only {only_a}; sql only {only_b}"


def main():
    import __spark_entry__ as entry
    from cohortlens.session import get_spark

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    wanted = sys.argv[1:]
    bad = []
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                result = None if query(spark, folder).count() >= 0 else "no rows"
                kind = "rows"
            else:
                result, kind = compare(spark, con, folder, query, sql), "sql"
        except Exception as error:
            result, kind = f"{type(error).__name__}: {str(error)[:1500]}", "error"
        print(f"{'ok ' if result is None else 'BAD'} {kind:5} {time.time() - start:6.2f}s {name} {result or ''}", flush=True)
        if result is not None:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
