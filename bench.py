"""Time the registered queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list; default every query except the
model fit, which is reported separately when ``BENCH_WITH_MODEL=1``).

Each query runs once to warm the JVM paths it uses, then is timed with a
``noop`` sink: the full plan executes, nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edspark.plans.catalog import QUERIES  # noqa: E402
from edspark.session import get_spark  # noqa: E402

SLOW_MODEL = {"acuity_classifier"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="edspark-bench",
                      **{"spark.sql.shuffle.partitions": str(2 * cpus), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or [
        q for q in QUERIES if q not in SLOW_MODEL or os.environ.get("BENCH_WITH_MODEL") == "1"]
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
