"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, Decimal):
        raise AssertionError("a decimal leaked into a result")
    return value


def difference(frame, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    spark_kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    }
    for name, kind in frame.dtypes:
        if spark_kinds[kind] != kinds[name]:
            return f"{name}: {kind} against {kinds[name]}"
    order = sorted(names)
    ours = Counter(tuple(_plain(row[c]) for c in order) for row in frame.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())
    if ours != theirs:
        left, right = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{sum(ours.values())} rows against {sum(theirs.values())}; only here {left}; only there {right}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from cellhealth.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session("oracle", **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            frame = build(spark, sf_dir)
            if name in sqls:
                found = difference(frame, con, sqls[name])
            else:
                found = None if frame.count() else "no rows"
        except Exception as failure:  # noqa: BLE001 - a report of all queries is wanted
            found = f"{type(failure).__name__}: {str(failure)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{bad} bad, {len(sqls)} with SQL; SQL without query: {sorted(set(sqls) - set(entry.queries()))}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
