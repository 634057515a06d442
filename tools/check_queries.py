"""Compare every registered query with its SQL on DuckDB.

    python tools/check_queries.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import decimal

    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else (f"{f:.6f}" if f != 0 else "0.000000")
    if isinstance(v, int):
        return f"{float(v):.6f}"
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def type_gaps(spark_df, con, sql):
    have = dict(spark_df.dtypes)
    want = {r[0]: SQL_TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (have.get(c), t) for c, t in want.items() if have.get(c) != t}


def compare(spark_df, con, sql):
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sql is None:
        return (f"rows only: {len(got)}", True)
    gaps = type_gaps(spark_df, con, sql)
    if gaps:
        return (f"types {gaps}", False)
    rel = con.execute(sql)
    want_names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_names != want_names:
        return (f"columns {got_names} != {want_names}", False)
    if len(got) != len(want):
        return (f"{len(got)} rows != {len(want)}", False)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return (f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}", False)
    return (f"{len(got)} rows", len(got) > 0)


def main():
    from cellframe.registry import REGISTRY
    from cellframe.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8", app="check")
    con = connect(sf_dir)
    failed = []
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            text, ok = compare(q.run(spark, sf_dir), con, q.sql)
        except Exception as exc:  # noqa: BLE001
            text, ok = f"{type(exc).__name__}: {str(exc)[:600]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
