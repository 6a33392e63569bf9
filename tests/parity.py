"""Spark-vs-DuckDB parity check (same idea as the driver's correctness gate).

Usage: python tests/parity.py [sf_dir] [name ...]
"""
from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], out


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols, s = rows_of(sdf.columns, srows)
    if sql is None:
        return dict(name=name, ok=None, rows=len(s), spark_s=round(t1 - t0, 2))
    res = con.sql(sql)
    dtypes = dict(zip(res.columns, [str(t) for t in res.types]))
    dcols, d = rows_of(res.columns, res.fetchall())
    t2 = time.time()
    stypes = dict(sdf.dtypes)
    type_diff = {c: (stypes[c], dtypes.get(c)) for c in stypes
                 if type_family(stypes[c]) != type_family(dtypes.get(c, ""))}
    ok = scols == dcols and s == d and not type_diff
    info = dict(name=name, ok=ok, rows=len(s), duck_rows=len(d), spark_s=round(t1 - t0, 2),
                duck_s=round(t2 - t1, 2))
    if type_diff:
        info["type_diff"] = type_diff
    if not ok:
        info["cols"] = (scols, dcols)
        diff_s = [r for r in s if r not in set(d)][:3]
        diff_d = [r for r in d if r not in set(s)][:3]
        info["only_spark"] = diff_s
        info["only_duck"] = diff_d
    return info


def main(argv):
    from bizlens.session import local_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    if os.environ.get("BIZLENS_PLAIN_SESSION"):
        # a session as a caller might build it: default shuffle partitions,
        # no checkpoint folder, optionally a non-UTC session time zone
        from pyspark.sql import SparkSession
        b = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        tz = os.environ.get("BIZLENS_SESSION_TZ")
        if tz:
            b = b.config("spark.sql.session.timeZone", tz)
        spark = b.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(shuffle_partitions=8)
    q, o = E.queries(), E.oracle_sql()
    con = duck_con(sf_dir)
    bad = 0
    for name in (names or list(q)):
        try:
            info = compare(spark, name, q[name], o.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            info = dict(name=name, ok=False, error=repr(e)[:800])
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0



def type_family(t: str) -> str:
    """Coarse type family used to compare Spark and DuckDB result schemas."""
    t = t.lower()
    for fam, keys in (("int", ("int", "long", "short", "byte")), ("float", ("double", "float", "decimal")),
                      ("str", ("string", "varchar", "char")), ("bool", ("bool",)), ("date", ("date",)),
                      ("ts", ("timestamp",))):
        if any(k in t for k in keys) and not t.startswith(("array", "list", "struct", "map")):
            return fam
    return t


if __name__ == "__main__":
    sys.exit(main(sys.argv))
