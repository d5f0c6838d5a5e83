"""Run registered queries on Spark and their SQL on DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from ebbline.sources.bridge import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(repr(value)) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return str(value)


def ordered(columns, rows):
    names = sorted(columns)
    index = [list(columns).index(n) for n in names]
    return names, sorted(
        ([plain(row[i]) for i in index] for row in rows), key=lambda r: [str(x) for x in r]
    )


def compare(spark, con, name, query, sql, sf_dir):
    """Empty text if both results agree, else what differs."""
    df = query(spark, sf_dir)
    got_names, got = ordered(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want_names, want = ordered(columns, result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ""


def main():
    from ebbline.session import local_session
    from ebbline.plans import catalog

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    failed = 0
    for name, query in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, catalog.ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        kind = "sql " if name in catalog.ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
