"""Compare registered queries with their SQL on the given tables.

Run as a script: ``python tests/oracle.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def duck_rows(con, statement: str):
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]).upper() for d in cursor.description}
    rows = [dict(zip(names, map(plain, row), strict=True)) for row in cursor.fetchall()]
    return names, types, rows


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def sort_key(row: dict, names: list[str]) -> tuple:
    return tuple(str(row[n]) for n in names)


def compare(spark_df, con, statement: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    names, types, expected = duck_rows(con, statement)
    rows = spark_df.collect()
    got = [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows]
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for name, kind in spark_df.dtypes:
        want = SAME_TYPE.get(kind)
        if want is not None and types[name] != want:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    if len(got) != len(expected):
        return problems + [f"rows {len(got)} != {len(expected)}"]
    cols = sorted(names)
    got.sort(key=lambda r: sort_key(r, cols))
    expected.sort(key=lambda r: sort_key(r, cols))
    for a, b in zip(got, expected, strict=True):
        if a != b:
            bad = {c: (a[c], b[c]) for c in cols if a[c] != b[c]}
            problems.append(f"values {str(bad)[:600]}")
            break
    return problems


def main() -> int:
    from tidemark.plans import ORACLES, QUERIES
    from tidemark.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problems = compare(df, con, ORACLES[name])
                n = df.count() if os.environ.get("COUNTS") else ""
            else:
                n, problems = len(df.collect()), []
        except Exception as exc:  # noqa: BLE001
            n, problems = "", [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        kind = "sql" if name in ORACLES else "rows"
        state = "FAIL" if problems else "ok"
        failed += bool(problems)
        print(f"{state:4} {kind:4} {name:28} {time.time() - start:6.2f}s {n}", flush=True)
        for p in problems:
            print("       ", p, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
