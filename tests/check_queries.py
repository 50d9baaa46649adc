"""Run registered queries against their SQL in DuckDB: python tests/check_queries.py [sf] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def compare(spark_df, relation, found: list) -> str | None:
    """None when equal, else the difference in words. ``found`` takes the rows of the SQL side."""
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} vs {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, [str(t) for t in relation.types]))
    expected_kind = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}
    for name, kind in spark_df.dtypes:
        if kind in expected_kind and kinds[name] not in (expected_kind[kind], '"NULL"'):
            return f"type of {name}: {kind} vs {kinds[name]}"
    got = sorted((repr(tuple(plain(r[n]) for n in names)) for r in spark_df.collect()))
    found.extend(relation.fetchall())
    order = [relation.columns.index(n) for n in names]
    want = sorted((repr(tuple(plain(r[i]) for i in order)) for r in found))
    if got == want:
        return None
    extra = [g for g in got if g not in set(want)][:3]
    lacking = [w for w in want if w not in set(got)][:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lacking}"


def main(argv: list[str]) -> int:
    from tests.conftest import make_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    prefixes = tuple(argv[1:]) or ("",)
    folder = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(folder)
    oracles, failed = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                found: list = []
                problem = compare(df, con.sql(oracles[name]), found)
                size = len(found)
            else:
                problem, size = None, f"{df.count()} (no SQL)"
        except Exception as error:  # report and go on to the next query
            problem, size = f"{type(error).__name__}: {str(error)[:900]}", "?"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:40s} {time.time() - start:6.2f}s rows={size} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
