"""Run registered queries against DuckDB and report differences."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value != 0 else "0.0"
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return f"{type(value).__name__} {value}"


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_key(r[i]) for i in order) for r in records)


def difference(spark, con, run, sql, folder) -> str | None:
    df = run(spark, folder)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not want:
        return "no rows to compare"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(got_names, a, b) if x != y]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cells[:4]}"
    return None


def main(argv):
    root = str(Path(__file__).resolve().parents[1])
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from packetloom.session import build_session

    folder = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(folder), entry.queries(), entry.oracle_sql()
    only = argv[1:] or list(queries)
    failed = 0
    for name in only:
        t = time.time()
        try:
            if name in oracle:
                problem = difference(spark, con, queries[name], oracle[name], folder)
            else:
                n = len(queries[name](spark, folder).collect())
                problem = None if n else "no rows"
                name += f" (rows only, {n})"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
    missing = sorted(set(oracle) - set(queries))
    print(f"{len(only) - failed} of {len(only)} agree; oracle without query: {missing}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
