"""Show rows that differ between a query and its oracle."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edspark.plans.catalog import QUERIES  # noqa: E402
from edspark.plans.compare import _norm, duckdb_connection, spark_rows  # noqa: E402
from edspark.plans.oracle import ORACLE  # noqa: E402
from edspark.session import get_spark  # noqa: E402

name = sys.argv[1]
sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = get_spark("local[8]")
df = QUERIES[name](spark, sf)
cols = df.columns
s = {repr([_norm(v) for v in r]) for r in spark_rows(df)}
con = duckdb_connection(sf)
res = con.execute(ORACLE[name])
dcols = [c[0] for c in res.description]
idx = [dcols.index(c) for c in cols]
d = {repr([_norm(r[i]) for i in idx]) for r in res.fetchall()}
print(cols)
print("spark-only", len(s - d))
for x in sorted(s - d)[:4]:
    print("  S", x)
print("duck-only", len(d - s))
for x in sorted(d - s)[:4]:
    print("  D", x)
