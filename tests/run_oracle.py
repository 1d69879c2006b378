"""Run registered queries against their DuckDB oracle: python tests/run_oracle.py [sf_dir] [name-prefix...]"""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from kiln.session import get_session  # noqa: E402
from kiln.plans.catalog import oracle_sql, queries  # noqa: E402
from oracle import compare, duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
prefixes = sys.argv[2:]
spark = get_session("local[8]", 8)
con = duck(sf)
qs, sqls = queries(), oracle_sql()
bad = 0
for name in sorted(qs):
    if prefixes and not any(name.startswith(p) for p in prefixes):
        continue
    t = time.time()
    try:
        df = qs[name](spark, sf)
        if name in sqls:
            r = compare(df, con, sqls[name])
            ok = r["hash_match"] and r["cols_match"] and r["rows_spark"] == r["rows_oracle"]
        else:
            r = {"rows_spark": df.count(), "oracle": None}
            ok = True
    except Exception as e:  # noqa: BLE001
        r, ok = {"error": (type(e).__name__ + ": " + str(e))[:700]}, False
    bad += not ok
    print(("OK  " if ok else "FAIL"), name, f"{time.time() - t:.1f}s", r, flush=True)
print("failures:", bad)
