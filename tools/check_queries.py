"""Compare every query with its SQL twin in DuckDB on one data folder.

    python tools/check_queries.py [folder] [name-part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harvestry.catalog import load_all  # noqa: E402
from harvestry.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("local[8]", "check", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    entries = load_all()
    for name, entry in entries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = entry(spark, folder)
            got = rows_of(df.columns, df.collect())
            spent = time.time() - started
            if entry.sql is None:
                print(f"ROWS  {name:40s} {len(got[1]):7d} rows {spent:6.2f}s", flush=True)
                continue
            cur = con.execute(entry.sql)
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            if got == want:
                print(f"OK    {name:40s} {len(got[1]):7d} rows {spent:6.2f}s", flush=True)
            else:
                bad += 1
                print(f"DIFF  {name:40s} {len(got[1])} vs {len(want[1])} rows; columns {got[0]} vs {want[0]}", flush=True)
                shown = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
                for a, b in shown:
                    print("   spark ", str(a)[:700]), print("   duckdb", str(b)[:700])
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(err).__name__} {str(err)[:900]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{bad} bad of {len(entries)}")


if __name__ == "__main__":
    main()
