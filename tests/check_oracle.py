"""Run registered queries next to their SQL and compare rows, types and values.

usage: python tests/check_oracle.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def compare(df, db, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    mine = sorted(tuple(_plain(v) for v in row) for row in df.select(*names).collect())
    result = db.execute(sql)
    described = {c[0]: str(c[1]) for c in result.description}
    if sorted(described) != names:
        return f"columns {names} vs {sorted(described)}"
    order = [list(described).index(n) for n in names]
    theirs = sorted(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(bad)} rows differ of {len(mine)}, columns {names}, e.g. {bad[0]}"
    types = dict(df.dtypes)
    odd = [(n, types[n], described[n]) for n in names if SAME.get(types[n], types[n]).upper() != described[n].upper()]
    if odd:
        return f"types {odd}"
    return None if mine else "no rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from shelfwise.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            note = compare(df, db, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:
            note = f"error {str(error)[:1500]}"
        bad = note is not None and not note.startswith("no SQL")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
