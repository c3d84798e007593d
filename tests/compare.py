"""Query results against DuckDB's, as bags of rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def bag(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, found.fetchall())
