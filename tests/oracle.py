"""Runs a registered query and its SQL and compares them as multisets of rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(_cell(v) for v in r) for r in df.select(*names).collect()]


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_cell(r[i]) for i in order) for r in rel.fetchall()]


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    names_a, a = rows_of_spark(query(spark, sf_dir))
    names_b, b = rows_of_sql(con, sql)
    if names_a != names_b:
        return f"columns {names_a} != {names_b}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a.sort(key=repr)
    b.sort(key=repr)
    for x, y in zip(a, b):
        if [type(v) for v in x] != [type(v) for v in y]:
            return f"types {x!r:.300} != {y!r:.300}"
        if x != y:
            return f"{x!r:.600} != {y!r:.600}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from textloom.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    sql = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                result = difference(spark, con, query, sql[name], sf) or "ok"
            else:
                result = f"rows only: {query(spark, sf).count()}"
        except Exception as e:  # report and go on with the next query
            result = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:22s} {time.time() - start:6.1f}s  {result}", flush=True)
