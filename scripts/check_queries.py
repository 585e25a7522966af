"""Compare every registered query with its SQL equivalent in DuckDB.

usage: check_queries.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseframe.plans import catalog  # noqa: E402
from caseframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value


def multiset(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, type(v).__name__, v) if not isinstance(v, list) else (True, "l", str(v)) for v in r))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = catalog.queries()[name](spark, sf_dir)
    mine = multiset(df.columns, df.collect())
    took = time.time() - start
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(mine):7d} {took:6.2f}s {name}: no SQL"
    start = time.time()
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    theirs = multiset(columns, cur.fetchall())
    duck = time.time() - start
    line = f"rows {len(mine):7d} {took:6.2f}s duck {duck:6.2f}s {name}: "
    if sorted(columns) != sorted(df.columns):
        return line + f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    if mine == theirs:
        return line + ("ok" if mine else "ok but EMPTY")
    diff = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
    return line + f"MISMATCH {len(theirs)} rows; {sorted(columns)}\n    spark {str(diff and diff[0])[:600]}\n    duck  {str(diff and diff[1])[:600]}"


def main() -> int:
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or sorted(catalog.queries())
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            line = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001 - a failing query is a result here
            line = f"{name}: ERROR {type(exc).__name__}: {str(exc)[:700]}"
        bad += "ok" not in line.split(": ", 1)[-1][:3] and "no SQL" not in line
        print(line, flush=True)
    print(f"{len(names)} queries, {bad} not matching")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
