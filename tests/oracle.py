"""Compare a Spark result with its SQL oracle in DuckDB. Also a command line: ``python tests/oracle.py 0.01 E``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else a short account of the first difference."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = _rows(names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not want:
        return "no rows to compare"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"columns {sorted(names)}\n    got  {a}\n    want {b}"
    return None


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = make_session()
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for key, function in entry.queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            note = difference(df, con, oracles[key]) if key in oracles else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed = note is not None and not note.startswith("rows only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {key} {time.time() - start:.2f}s {note or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
