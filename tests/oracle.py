"""Run registered queries and their DuckDB counterparts side by side."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(name: str) -> str:
    name = name.lower()
    return {"int": "integer", "string": "varchar", "long": "bigint"}.get(name, name)


def compare(df, con, sql: str) -> str:
    """Empty when names, types and values agree, else what differs."""
    expected = con.execute(sql)
    theirs = {d[0]: _kind(str(d[1])) for d in expected.description}
    ours = {c: _kind(t) for c, t in df.dtypes}
    if theirs != ours:
        return f"schema: {ours} != {theirs}"
    columns = sorted(ours)

    def rows(values, order):
        places = [order.index(c) for c in columns]
        return sorted((tuple(r[i] for i in places) for r in values), key=repr)

    got = rows((tuple(r) for r in df.collect()), df.columns)
    want = rows(expected.fetchall(), [d[0] for d in expected.description])
    if len(got) != len(want):
        return f"rows: {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            off = sum(repr(a) != repr(b) for a, b in zip(got, want))
            return f"values ({off} rows) {columns}: {g} != {w}"
    return ""


def main(sf_dir: str, only: list[str]) -> None:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import session

    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in only or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                result = compare(df, con, oracles[name]) or "ok"
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("without oracle:", sorted(set(queries) - set(oracles)))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
