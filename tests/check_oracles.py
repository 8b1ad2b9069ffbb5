"""Run registered queries beside their SQL statements and compare. Usage: check_oracles.py [sf] [name prefixes...]"""
import importlib.util
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def entry_module():
    spec = importlib.util.spec_from_file_location("entry_mod", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        if hasattr(v, "isoformat"):
            s = v.isoformat()
            return s[:10] if s.endswith("T00:00:00") else s
        return str(v)
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description."""
    got = fn(spark, sf_dir).toPandas()
    if sql is None:
        return None, len(got)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", len(got)
    a, b = norm(got), norm(want)
    if a == b:
        return None, len(got)
    sa, sb = set(a), set(b)
    return f"rows {len(a)} vs {len(b)}; cols {sorted(got.columns)}; only spark {list(sa - sb)[:3]}; only sql {list(sb - sa)[:3]}", len(got)


if __name__ == "__main__":
    from siftwork.session import local_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    m = entry_module()
    spark, con = local_session(8), connect(sf_dir)
    oracles, bad = m.oracle_sql(), 0
    for name, fn in m.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            why, n = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            why, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        tag = "FAIL" if why else ("ok  " if name in oracles else "rows")
        bad += bool(why)
        print(f"{tag} {name} rows={n} {time.time() - t:.1f}s {(why or '')[:1500]}", flush=True)
    print("failures:", bad)
