"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.oracle import ORACLE_SQL
from checks.registry import QUERIES
from citeflow.session import local_session

TABLES = "documents benchmark embeddings pages conversations events labels".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf: str, name: str) -> str:
    start = time.time()
    table = QUERIES[name](spark, sf).toArrow()
    took = time.time() - start
    if name not in ORACLE_SQL:
        return f"ROWS ONLY {table.num_rows} rows, {took:.1f}s"
    start = time.time()
    want = con.sql(ORACLE_SQL[name]).to_arrow_table()
    sql_took = time.time() - start
    columns = sorted(table.column_names)
    if columns != sorted(want.column_names):
        return f"COLUMNS {columns} vs {sorted(want.column_names)}"
    types = {
        c: (str(table.schema.field(c).type), str(want.schema.field(c).type))
        for c in columns
        if str(table.schema.field(c).type).replace("large_", "") != str(want.schema.field(c).type).replace("large_", "")
    }

    def rows(t):
        return Counter(zip(*[t.column(c).to_pylist() for c in columns]))

    have, expected = rows(table), rows(want)
    note = f" types {types}" if types else ""
    if have == expected:
        return f"ok {table.num_rows} rows, {took:.1f}s, sql {sql_took:.1f}s{note}"
    more, less = have - expected, expected - have
    return (
        f"DIFF {table.num_rows} vs {want.num_rows} rows, {sum(more.values())} extra, {sum(less.values())} missing{note}\n"
        f"   spark {str(next(iter(more), None))[:1500]}\n   sql   {str(next(iter(less), None))[:1500]}"
    )


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), duck(sf)
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            result = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        bad += not result.startswith(("ok", "ROWS ONLY"))
        print(f"{name}: {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
