"""Run registered queries on Spark and their SQL on DuckDB; report differences.

Usage: python tests/compare.py [sf] [key-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def kind(arrow_type) -> str:
    import pyarrow.types as pt

    if pt.is_integer(arrow_type):
        return "int"
    if pt.is_floating(arrow_type):
        return "float"
    if pt.is_string(arrow_type) or pt.is_large_string(arrow_type):
        return "str"
    return str(arrow_type)


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(norm(v) for v in row) for row in zip(*cols)) if cols else []


def compare(spark_table, duck_table) -> str | None:
    a = {f.name: kind(f.type) for f in spark_table.schema}
    b = {f.name: kind(f.type) for f in duck_table.schema}
    if a != b:
        return f"schema {sorted(set(a.items()) ^ set(b.items()))}"
    x, y = rows_of(spark_table), rows_of(duck_table)
    if len(x) != len(y):
        return f"rows {len(x)} vs {len(y)}"
    for r, s in zip(x, y):
        if r != s:
            diff = [(n, p, q) for n, p, q in zip(sorted(a), r, s) if p != q]
            return f"values {diff[:4]} in {sum(p != q for p, q in zip(x, y))} rows"
    return None


def main(argv: list[str]) -> int:
    from tests.session import spark_session

    import __spark_entry__ as e

    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = spark_session()
    con = duck(sf_dir)
    sqls = e.oracle_sql()
    bad = 0
    for key, fn in e.queries().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
            t1 = time.time()
            if key not in sqls:
                print(f"ROWS {key} {got.num_rows} {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(sqls[key]).to_arrow_table()
            t2 = time.time()
            why = compare(got, want)
            slow = f" {t1 - t0:.1f}s duck {t2 - t1:.1f}s" if t2 - t0 > 4 else ""
            print(f"{'OK  ' if why is None else 'DIFF'} {key} n={got.num_rows}{slow} {why or ''}", flush=True)
            bad += why is not None
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL {key} {type(err).__name__}: {str(err)[:700]}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
