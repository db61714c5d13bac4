"""Compare registered queries with their SQL in DuckDB.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def compare(columns_a, rows_a, columns_b, rows_b) -> str | None:
    """None when equal, else what differs. Floats must agree exactly after the plans' rounding."""
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(columns_a)} vs {sorted(columns_b)}"
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} vs {len(rows_b)}"
    order = sorted(columns_a)

    def shape(columns, rows):
        at = [columns.index(c) for c in order]
        return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple(
            (v is None, "" if v is None else kind(v), str(round(v, 4) + 0.0) if isinstance(v, float) else str(v)) for v in r))

    loose = 0
    for x, y in zip(shape(columns_a, rows_a), shape(columns_b, rows_b)):
        for c, u, v in zip(order, x, y):
            if u == v and kind(u) == kind(v):
                if isinstance(u, float) and math.copysign(1, u) != math.copysign(1, v):
                    return f"{c}: sign of zero"
                continue
            if isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6):
                loose += 1
                continue
            return f"{c}: {u!r} vs {v!r} in {x} vs {y}"
    return f"only nearly equal in {loose} cells" if loose else None


def run(spark, con, plan, sql, sf_dir) -> dict:
    """Run one query on both sides: verdict, seconds, rows and the text of the Spark plan."""
    start = time.time()
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    out = {"verdict": "rows only", "spark": time.time() - start, "duck": 0.0, "rows": len(got),
           "plan": df._jdf.queryExecution().executedPlan().toString()}
    if sql is None:
        return out
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    return {**out, "duck": time.time() - start, "verdict": compare(df.columns, got, names, want) or "ok"}


if __name__ == "__main__":
    import __spark_entry__ as entry_module
    from pacemark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = local_session(), duck(folder)
    sqls = entry_module.oracle_sql()
    for name, plan in entry_module.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            r = run(spark, con, plan, sqls.get(name), folder)
        except Exception as e:  # report and go on with the next query
            r = {"verdict": f"ERROR {type(e).__name__}: {str(e)[:600]}", "spark": 0, "duck": 0, "rows": 0}
        print(f"{name:28s} {r['rows']:8d} rows  spark {r['spark']:6.2f}s  duck {r['duck']:6.2f}s  {r['verdict']}", flush=True)
