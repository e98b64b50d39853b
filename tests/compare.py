"""Compare queries with their SQL: python tests/compare.py SF NAME... (no name: all with SQL)."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return str([value(x) for x in v])
        return str(v)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        name = f.split(".")[0]
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    df = query(spark, sf_dir)
    a = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    b = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    if a == b:
        return True, f"{len(a[1])} rows"
    if a[0] != b[0]:
        return False, f"columns {a[0]} and {b[0]}"
    left, right = set(a[1]), set(b[1])
    return False, f"{len(a[1])} and {len(b[1])} rows; only here {sorted(left - right)[:3]}; only in SQL {sorted(right - left)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from weftline.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8)
    known, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or known:
        began = time.time()
        if name in oracle:
            try:
                good, said = compare(spark, sf_dir, known[name], oracle[name])
            except Exception as e:  # noqa: BLE001
                good, said = False, str(e)[:400]
            print(f"{'ok  ' if good else 'DIFF'} {name} {time.time() - began:.1f} s {said}", flush=True)
        else:
            print(f"rows {name} {known[name](spark, sf_dir).count()} in {time.time() - began:.1f} s", flush=True)
