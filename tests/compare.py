"""Side-by-side run of catalogue queries and their SQL twins.

Usage: ``python -m tests.compare SF_DIR [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def oracle_connection(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, _cell(v)) for k, v in sorted(x.items()))
    return x


def normalised(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def run_pair(spark, con, root, run, sql):
    """Difference text, or ``None`` when both sides agree in columns, types and values."""
    df = run(spark, root)
    left_cols, left = normalised([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    right_cols, right = normalised(cur.fetchall(), names)
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y or type(x) is not type(y)]
            return f"first difference {diff[:4]}"
    return None


def main() -> None:
    from tenderlake import catalog
    from tenderlake.session import build_session

    root, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(root)
    queries, oracles = catalog.queries(), catalog.oracles()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = run_pair(spark, con, root, run, oracles[name])
                size = ""
            else:
                problem, size = None, f"rows={run(spark, root).count()}"
        except Exception as exc:  # noqa: BLE001 - the report names whatever failed
            problem, size = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {size} {problem or ''}", flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main()
