"""Run every registered query against its oracle (dev tool).

usage: python tests/check_all.py [sf_dir] [name ...]
"""

import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck_connection  # noqa: E402
from dayspan.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
con = duck_connection(sf)
qs, orc = E.queries(), E.oracle_sql()
bad = 0
for n, fn in qs.items():
    if names and n not in names:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if n in orc:
            r = compare(df, con, orc[n])
        else:
            r = {"ok": None, "spark_rows": df.count(), "rows_only": True}
    except Exception as e:  # noqa: BLE001
        r = {"ok": False, "error": repr(e)[:600]}
        traceback.print_exc()
    r["sec"] = round(time.time() - t, 2)
    bad += r.get("ok") is False
    print(n, json.dumps(r, default=str), flush=True)
print("FAILED", bad)
