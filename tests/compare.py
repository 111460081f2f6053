"""Run a registered query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def database(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) or v is None else (False, "n", v) for v in r))


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return normal([c[0] for c in cursor.description], cursor.fetchall())


def check(con, df, sql) -> str | None:
    """None when both sides agree, else the first difference."""
    got = spark_rows(df)
    if sql is None:
        return None if got[1] else "no rows"
    want = sql_rows(con, sql)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if not got[1]:
        return "both empty"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"spark {str(a)[:300]} != sql {str(b)[:300]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from assay.session import local_session

    sf_dir = argv[0]
    names = argv[1:]
    spark = local_session(cpus=8)
    con = database(sf_dir)
    con.execute("SET TimeZone='UTC'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            problem = check(con, fn(spark, sf_dir), oracle.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t0:6.2f}s {name} {'' if oracle.get(name) else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
