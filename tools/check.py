"""Run registered queries against their oracle SQL: python tools/check.py [sf] [name-regex]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import duckdb  # noqa: E402

from matchlake.catalog import load_all  # noqa: E402
from matchlake.fixtures import TABLES  # noqa: E402
from matchlake.session import get_spark  # noqa: E402


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"f:{v + 0.0!r}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (dt.date, dt.datetime)):
        return f"t:{v}"
    return f"s:{v}"


def canonical_rows(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in idx) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pat = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark("check", 8)
    queries = load_all()
    bad = 0
    for name, q in queries.items():
        if not pat.search(name):
            continue
        t0 = time.time()
        try:
            df = q(spark, sf_dir)
            got = df.collect()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
            continue
        secs = time.time() - t0
        if q.oracle is None:
            print(f"ROWS {name}: {len(got)} rows {secs:.2f}s", flush=True)
            continue
        con = duckdb.connect()
        con.execute("SET threads TO 4")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        try:
            cur = con.execute(q.oracle_sql)
            ocols = [c[0] for c in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"OERR {name}: {str(e)[:1500]}", flush=True)
            continue
        if sorted(df.columns) != sorted(ocols):
            bad += 1
            print(f"COLS {name}: spark {sorted(df.columns)} oracle {sorted(ocols)}", flush=True)
            continue
        a, b = canonical_rows(df.columns, got), canonical_rows(ocols, want)
        if a != b:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"DIFF {name}: spark {len(a)} oracle {len(b)}; cols {sorted(ocols)}", flush=True)
            print("   spark only ", sorted(sa - sb)[:3])
            print("   oracle only", sorted(sb - sa)[:3], flush=True)
        else:
            print(f"OK   {name}: {len(a)} rows {secs:.2f}s", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
