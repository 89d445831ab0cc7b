"""Run queries on Spark and their check SQL on DuckDB and compare the results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if not Path(f"{folder}/{t}.parquet").exists():
            continue
        suffix = "/*.parquet" if Path(f"{folder}/{t}.parquet").is_dir() else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{suffix}')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def compare(df, con, query: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when they are equal."""
    problems = []
    theirs = con.execute(query)
    columns = [c[0] for c in theirs.description]
    kinds = {c[0]: str(c[1]) for c in theirs.description}
    want = theirs.fetchall()
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    order = sorted(columns)
    got = sorted(tuple(_value(r[c]) for c in order) for r in df.collect())
    index = [columns.index(c) for c in order]
    want = sorted(tuple(_value(r[i]) for i in index) for r in want)
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        mine, other = set(got) - set(want), set(want) - set(got)
        problems.append(f"values differ: {len(mine)} | {len(other)}")
        problems.append(f"spark {sorted(mine)[:3]}")
        problems.append(f"sql   {sorted(other)[:3]}")
    return problems


def main() -> int:
    from larder.plans.registry import all_queries
    from larder.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name, (run, query) in all_queries().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            if query is None:
                n = len(df.collect())
                print(f"rows {name}: {n} rows {time.time() - began:.1f}s", flush=True)
                continue
            problems = compare(df, con, query)
            n = con.execute(f"SELECT count(*) FROM ({query})").fetchone()[0]
        except Exception as e:  # noqa: BLE001
            problems, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name}: {n} rows {time.time() - began:.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
