"""Run every registered query against its DuckDB oracle (or rows-only)."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edspark.plans.catalog import QUERIES  # noqa: E402
from edspark.plans.compare import compare, duckdb_connection  # noqa: E402
from edspark.plans.oracle import ORACLE  # noqa: E402
from edspark.session import get_spark  # noqa: E402


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = get_spark("local[8]")
    con = duckdb_connection(sf)
    bad = []
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLE:
                ok, det = compare(df, con, ORACLE[name])
            else:
                n = df.count()
                ok, det = True, {"rows_only": n, "columns": df.columns}
        except Exception as e:  # noqa: BLE001
            ok, det = False, {"error": str(e)[:800]}
        print(("OK  " if ok else "FAIL"), name, f"{time.time() - t:.1f}s", json.dumps(det, default=str)[:900],
              flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
