"""Runs registered queries against their SQL on DuckDB: ``python tests/compare.py [names] [--sf DIR]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return str(v)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns)) if columns else []


def type_class(t) -> str:
    s = str(t).replace("large_", "").replace("_view", "")
    return "timestamp" if s.startswith("timestamp") else s


def compare(spark, con, name: str, build, sql: str | None, sf_dir: str) -> str:
    start = time.time()
    got = build(spark, sf_dir).toArrow()
    spent = time.time() - start
    if sql is None:
        return f"rows-only {got.num_rows} rows {spent:.1f}s"
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"FAIL columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    a, b = rows_of(got), rows_of(want)
    types = [
        f"{n}:{got.schema.field(n).type}/{want.schema.field(n).type}"
        for n in got.column_names
        if type_class(got.schema.field(n).type) != type_class(want.schema.field(n).type)
    ]
    note = f" TYPES {types}" if types else ""
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"FAIL rows {len(a)}/{len(b)}\n   spark {only_a}\n   sql   {only_b}{note}"
    return f"ok {len(a)} rows {spent:.1f}s{note}"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf_dir = args[i + 1]
        del args[i : i + 2]
    import __spark_entry__ as entry
    from wiretally.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            print(f"{name}: {compare(spark, con, name, build, oracles.get(name), sf_dir)}", flush=True)
        except Exception as e:  # a broken query is reported, the rest still run
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    spark.stop()


if __name__ == "__main__":
    main()
