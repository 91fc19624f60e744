"""Compare registered queries with their SQL on the given tables.

    python tests/oracle.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"f:{value!r}" if value != 0 else "f:0.0"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        extra = set(mine[1]) - set(theirs[1])
        lack = set(theirs[1]) - set(mine[1])
        return f"rows {len(mine[1])} != {len(theirs[1])}\n  spark only {list(extra)[:2]}\n  sql only   {list(lack)[:2]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"values\n  spark {a}\n  sql   {b}"
    return None


def main(argv: list[str]) -> int:
    from annalist.session import local_session
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark, con = local_session(), duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sql:
                problem = compare(df, con, sql[name])
                note = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                problem, note = None, f"rows {df.count()}"
        except Exception as error:  # report and go on
            problem = note = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
