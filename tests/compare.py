"""Runs registered queries and their SQL side by side: ``python tests/compare.py [folder] [key ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from assay.catalog.tables import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return v


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(body, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_side(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def sql_side(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return table_of(names, cur.fetchall())


def difference(ours, theirs) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}: {ours[1][:3]} / {theirs[1][:3]}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} rows differ, first {bad[:2]}" if bad else None


def main() -> None:
    from assay.session import local_session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls = oracle_sql()
    bad = 0
    for key, run in queries().items():
        if wanted and key not in wanted:
            continue
        t = time.time()
        try:
            ours = spark_side(run(spark, folder))
            t1 = time.time()
            problem = difference(ours, sql_side(con, sqls[key])) if key in sqls else None
            label = ("DIFF " + problem) if problem else ("ok" if key in sqls else "ok (rows only)")
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            ours = ([], [])
            label = f"FAIL {type(e).__name__}: {str(e)[:400]}"
        bad += not label.startswith("ok")
        print(f"{key:32s} {len(ours[1]):7d} rows {t1 - t:6.1f}s  {label}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
