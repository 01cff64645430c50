"""Run registered Spark queries next to their DuckDB SQL and compare
row count, column names and every value (exact, order-insensitive).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return json.dumps([canon(x) for x in v])
    if isinstance(v, dict):
        return json.dumps({str(k): canon(x) for k, x in sorted(v.items())})
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of_spark(df):
    cols = df.columns
    return cols, [tuple(r[c] for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    return cols, rel.fetchall()


def compare(spark_cols, spark_rows, duck_cols, duck_rows):
    out = {"rows_spark": len(spark_rows), "rows_oracle": len(duck_rows)}
    if sorted(spark_cols) != sorted(duck_cols):
        out["ok"] = False
        out["error"] = f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
        return out
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted(tuple(canon(r[i]) for i in si) for r in spark_rows)
    b = sorted(tuple(canon(r[i]) for i in di) for r in duck_rows)
    out["ok"] = a == b
    if not out["ok"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = [dict(zip(order, r)) for r in sorted(sa - sb)[:3]]
        out["only_oracle"] = [dict(zip(order, r)) for r in sorted(sb - sa)[:3]]
    return out


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from curbscope.session import ensure_checkpoint_dir, get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_spark()
    ensure_checkpoint_dir(spark)
    con = duck_connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sc, sr = rows_of_spark(qs[name](spark, sf_dir))
            t1 = time.time()
            if name not in sqls:
                print(f"{name:28s} rows={len(sr):6d} (no oracle) spark={t1 - t0:.2f}s")
                continue
            dc, dr = rows_of_duck(con, sqls[name])
            res = compare(sc, sr, dc, dr)
        except Exception as exc:  # noqa: BLE001
            failed += 1
            print(f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:600]}")
            continue
        status = "OK " if res["ok"] else "BAD"
        failed += 0 if res["ok"] else 1
        print(f"{name:28s} {status} rows={res['rows_spark']}/{res['rows_oracle']} "
              f"spark={t1 - t0:.2f}s")
        if not res["ok"]:
            print("   ", json.dumps({k: v for k, v in res.items() if k not in ("ok",)},
                                    ensure_ascii=False)[:2000])
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
