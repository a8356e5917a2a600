"""Run registered queries against their SQL: ``python tools/check.py [prefix ...]``."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

from tidewatch.queries import ORACLES, QUERIES  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=os.environ.get("CHECK_PARTITIONS", "8"), spark__driver__memory="8g", spark__ui__enabled="false")
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
for name, fn in QUERIES.items():
    if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
        continue
    start = time.time()
    try:
        problems = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
    except Exception as error:
        problems = [f"{name}: {str(error)[:1500]}"]
        if os.environ.get("TRACE"):
            traceback.print_exc()
    bad += bool(problems)
    print("OK  " if not problems else "FAIL", name, f"{time.time() - start:.1f}s", "" if name in ORACLES else "(rows only)", flush=True)
    for problem in problems:
        print("    ", problem[:1800], flush=True)
print("failing:", bad)
