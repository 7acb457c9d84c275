"""Compare registered queries with their SQL answers. Also used by test_oracle."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return f"{v.normalize():f}"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    assert ours[0] == theirs[0], (name, ours[0], theirs[0])
    a, b = set(ours[1]), set(theirs[1])
    assert len(ours[1]) == len(theirs[1]) and a == b, (
        name, len(ours[1]), len(theirs[1]), sorted(a - b)[:3], sorted(b - a)[:3])
    return len(ours[1])


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from tests.conftest import make_session
    spark, sf_dir = make_session(), sys.argv[1]
    con, sql = connect(sf_dir), e.oracle_sql()
    for name, query in e.queries().items():
        if name not in sql or (len(sys.argv) > 2 and name not in sys.argv[2:]):
            continue
        t = time.time()
        try:
            n = compare(spark, con, name, query, sql[name], sf_dir)
            print(f"{name}: ok {n} rows {time.time() - t:.1f}s", flush=True)
        except Exception as err:
            print(f"{name}: FAIL {str(err)[:900]}", flush=True)
