"""Run registered queries in Spark and their SQL in DuckDB, and compare every row.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, repr(v))
    return (1, str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want_kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in got.description}
    want = got.fetchall()
    have = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if kinds != want_kinds:
        return f"types {[(k, kinds[k], want_kinds[k]) for k in kinds if kinds[k] != want_kinds[k]]}"
    a, b = _rows(df.columns, have), _rows(names, want)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows vs {len(b)}; only spark {str(only_a)[:700]}; only sql {str(only_b)[:700]}"


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from mediaseries.session import build_session

    spark = build_session("local[8]")
    con = connect(sf_dir)
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), 0
    for name in only or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name not in sqls:
                print(f"ROWS  {name:30s} {df.count()}", flush=True)
                continue
            problem = difference(df, con, sqls[name])
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5s} {name:30s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
