"""Run registered queries next to their reference SQL and compare the results.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 5) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 5) + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return abs(a - b) <= 1.1e-5 * max(1.0, abs(a), abs(b))
    return a == b


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), [tuple(normal(r[i]) for i in order) for r in data]


def compare(left, right) -> str:
    (ca, a), (cb, b) = left, right
    if ca != cb:
        return f"columns differ: {ca} vs {cb}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if Counter(map(str, a)) == Counter(map(str, b)):
        return "ok"
    sort = lambda rows: sorted(rows, key=lambda r: [("", "") if v is None else (type(v).__name__ if not isinstance(v, (int, float)) else "n", str(round(v, 3)) if isinstance(v, float) else str(v)) for v in r])
    bad = [(x, y) for x, y in zip(sort(a), sort(b)) if not all(same(p, q) for p, q in zip(x, y))]
    return "ok" if not bad else f"{len(bad)} rows differ, e.g. spark={bad[0][0]} sql={bad[0][1]}"


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


EXACT = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def type_notes(con, sql, df) -> str:
    """Columns whose types differ between the two engines."""
    cur = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in cur.description}
    ours = dict(df.dtypes)
    bad = [f"{c}: {ours[c]}/{theirs.get(c)}" for c in ours if EXACT.get(ours[c]) != theirs.get(c)]
    return " TYPES " + ", ".join(bad) if bad else ""


def sql_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def main():
    import __spark_entry__ as entry
    from eddyline.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    con = duck(folder)
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = spark_rows(df)
            took = time.time() - start
            verdict = compare(got, sql_rows(con, oracles[name])) if name in oracles else f"rows only: {len(got[1])}"
            size = len(got[1])
            if verdict == "ok":
                verdict += type_notes(con, oracles[name], df)
        except Exception as error:  # noqa: BLE001
            took, verdict, size = time.time() - start, "ERROR " + str(error)[:600].replace("\n", " | "), 0
        if not verdict.startswith(("ok", "rows only")):
            failures.append(name)
        print(f"{took:6.2f}s {size:7d} {name:34s} {verdict}", flush=True)
    print("FAILED:", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
