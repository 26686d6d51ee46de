"""Run queries against their oracles: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (dt.date, bool)) or value is None:
        return str(value)
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def kinds(schema) -> dict[str, str]:
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    return {f.name: names.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in schema}


def compare(spark, con, run, sql: str, sf_dir: str) -> tuple[str | None, int, float]:
    """(difference or None, rows, seconds)."""
    started = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    types = {c[0]: str(c[1]) for c in relation.description}
    want = rows_of(columns, relation.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}", len(got), took
    mine = kinds(df.schema)
    wrong = {c: (mine[c], types[c]) for c in columns if mine[c] != types[c]}
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}", len(got), took
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(pairs)} rows differ, first {pairs[0]}", len(got), took
    return (f"types {wrong}" if wrong else None), len(got), took


def main() -> int:
    from clickspan.catalogue import ORACLES, QUERIES
    from clickspan.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name in names:
        try:
            if name in ORACLES:
                difference, rows, took = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                started = time.time()
                difference, rows = None, QUERIES[name](spark, sf_dir).count()
                took = time.time() - started
        except Exception as error:
            difference, rows, took = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0
        failures += difference is not None
        print(f"{'ok  ' if difference is None else 'FAIL'} {name} rows={rows} {took:.2f}s {difference or ''}", flush=True)
    print(f"{len(names)} queries, {failures} failures")
    return failures


if __name__ == "__main__":
    raise SystemExit(main() > 0)
