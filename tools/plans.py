"""Summarise the physical plan of every registered query (after AQE) into a
markdown table: shuffles, broadcasts, pushed scan filters, Python stages."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edspark.plans.catalog import QUERIES  # noqa: E402
from edspark.session import get_spark  # noqa: E402

SKIP = {"acuity_classifier", "feature_matrix", "linear_attribution", "complaint_features", "csv_roundtrip",
        "vector_roundtrip"}


def summarize(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "python": ("BatchEvalPython" in plan) or ("ArrowEvalPython" in plan),
        "cartesian": "CartesianProduct" in plan,
        "pushed": sorted({m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m}),
    }


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    rows = []
    for name, fn in QUERIES.items():
        if name in SKIP or name.startswith("stream_"):
            continue
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        rows.append(f"| {name} | {s['shuffles']} | {s['bhj']}/{s['smj']} | {s['broadcasts']} | "
                    f"{'yes' if s['python'] else 'no'} | {'yes' if s['cartesian'] else 'no'} | "
                    f"{'; '.join(p[:80] for p in s['pushed'][:2]) or '-'} |")
    print("| query | shuffles (initial plan) | broadcast/sort-merge joins | broadcast exchanges | Python | Cartesian | "
          "pushed scan filters |")
    print("|---|---|---|---|---|---|---|")
    print("\n".join(rows))


if __name__ == "__main__":
    main()
