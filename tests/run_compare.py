"""python tests/run_compare.py [name part ...] — compare queries with their SQL from the shell."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as e  # noqa: E402
from compare import compare  # noqa: E402
from veriform.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", os.environ.get("MASTER", "local[8]"), 8, "4g")
    spark.sparkContext.setLogLevel("ERROR")
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if sys.argv[1:] and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in sys.argv[1:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, sf, fn, sqls[name])
            else:
                n = fn(spark, sf).count()
                msg = None if n else "no rows"
                print("   rows only", n, end=" ")
        except Exception as exc:  # report and go on
            msg = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print("bad:", bad)
