"""Run registered queries on Spark and their oracle SQL on DuckDB; print a
per-query match table.  Usage: python tools_oracle.py [sf_dir] [name ...]"""
import json
import sys
import time

from quillon.session import build_session
from quillon.plans.registry import queries, oracle_sql
from quillon.plans.checker import duckdb_connection, compare

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"})
con = duckdb_connection(sf)
Q, S = queries(), oracle_sql()
bad = 0
for n in (names or sorted(Q)):
    t = time.time()
    try:
        df = Q[n](spark, sf)
        if n in S:
            r = compare(df, S[n], con)
            ok = r["values_match"]
        else:
            r = {"spark_rows": df.count()}
            ok = None
    except Exception as e:  # report and continue
        r, ok = {"error": (type(e).__name__ + ": " + str(e))[:800]}, False
    bad += ok is False
    print(json.dumps({"q": n, "ok": ok, "sec": round(time.time() - t, 2), **r}, default=str)[:1500], flush=True)
print("FAILED", bad)
