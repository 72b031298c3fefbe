"""Compare each registered Spark query with its DuckDB oracle.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names, type families and an order-insensitive
hash of the values (floats rounded to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def family(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long", "int64"):
        return "int64"
    if t in ("int", "integer", "int32"):
        return "int32"
    if t in ("smallint", "short", "int16", "tinyint", "byte", "int8"):
        return "int-small"
    if t in ("double", "float64"):
        return "float64"
    if t in ("float", "real", "float32"):
        return "float32"
    if t in ("string", "varchar", "text"):
        return "string"
    if t.startswith("decimal"):
        return "decimal"
    if t in ("timestamp_ntz", "timestamp"):
        return "timestamp"
    if t in ("timestamp with time zone", "timestamptz"):
        return "timestamptz"
    if t.startswith("array") or t.endswith("[]"):
        return "array"
    if t.startswith("struct"):
        return "struct"
    if t == "hugeint":
        return "int128"
    return t


def compare(spark, name, sf_dir, verbose=False):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = [family(f.dataType.simpleString()) for f in sdf.schema.fields]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    con = duck(sf_dir)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dtypes = [family(str(t)) for t in rel.types]
    drows = rel.fetchall()
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2)}
    res["cols_ok"] = sorted(scols) == sorted(dcols)
    st = dict(zip(scols, stypes))
    dtp = dict(zip(dcols, dtypes))
    res["type_diff"] = {c: (st.get(c), dtp.get(c)) for c in set(scols) | set(dcols) if st.get(c) != dtp.get(c)}
    if res["cols_ok"]:
        h1, l1 = _digest(scols, srows)
        h2, l2 = _digest(dcols, drows)
        res["hash_ok"] = h1 == h2
        if h1 != h2 and verbose:
            s1, s2 = set(l1), set(l2)
            res["only_spark"] = sorted(s1 - s2)[:3]
            res["only_oracle"] = sorted(s2 - s1)[:3]
    else:
        res["hash_ok"] = False
        res["cols"] = (sorted(scols), sorted(dcols))
    res["ok"] = res["cols_ok"] and res["hash_ok"] and len(srows) == len(drows) and not res["type_diff"]
    return res


def main():
    from domus.session import get_spark
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    if os.environ.get("DOMUS_PLAIN_SESSION"):
        # a session with Spark defaults only (as a caller's own session would be)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark()
    import __spark_entry__ as E
    names = names or list(E.queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, verbose=True)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "error": repr(e)[:400]}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
