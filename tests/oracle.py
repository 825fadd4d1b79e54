"""Compare registered queries with their SQL on the same Parquet tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, folder):
    """(ok, message) of one query."""
    start = time.time()
    df = fn(spark, folder)
    rows = _sorted([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = _sorted(cur.fetchall(), columns)
    sql_took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if rows != want:
        bad = [(a, b) for a, b in zip(rows, want) if a != b][:3]
        return False, f"{len(rows)} vs {len(want)} rows, first differences {bad}"
    return True, f"{len(rows)} rows, {took:.1f}s (sql {sql_took:.1f}s)"


def main():
    import __spark_entry__ as entry
    from oddledger.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, name, fn, sql.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
