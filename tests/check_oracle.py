"""Run registered queries next to their SQL in DuckDB and compare the results.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in column names, types and rows; empty when equal."""
    problems = []
    names = sorted(spark_df.columns)
    cursor = con.execute(sql)
    got = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(got) != names:
        return [f"columns {names} against {sorted(got)}"]
    kinds = dict(spark_df.dtypes)
    for n in names:
        if KINDS.get(got[n], got[n]) != kinds[n]:
            problems.append(f"type of {n}: {kinds[n]} against {got[n]}")
    order = [d[0] for d in cursor.description]
    places = [order.index(n) for n in names]
    want = Counter(tuple(plain(row[p]) for p in places) for row in cursor.fetchall())
    have = Counter(tuple(plain(v) for v in row) for row in spark_df.select(*names).collect())
    if want != have:
        problems.append(f"rows {sum(have.values())} against {sum(want.values())}")
        for row in list((have - want).elements())[:3]:
            problems.append(f"  only here: {dict(zip(names, row))}")
        for row in list((want - have).elements())[:3]:
            problems.append(f"  only in SQL: {dict(zip(names, row))}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from ebbtide.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problems = compare(df, con, sql[name])
            else:
                problems = [] if df.count() > 0 else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        kind = "sql" if name in sql else "rows"
        print(f"{'BAD' if problems else 'ok ':4s}{kind:5s}{name:32s}{time.time() - start:7.2f}s", *problems, sep="\n    " if problems else "", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
