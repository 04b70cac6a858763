"""List columns whose Spark type and DuckDB oracle type differ."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edspark.plans.catalog import QUERIES  # noqa: E402
from edspark.plans.compare import duckdb_connection  # noqa: E402
from edspark.plans.oracle import ORACLE  # noqa: E402
from edspark.session import get_spark  # noqa: E402

SPARK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
         "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]", "binary": "BLOB"}
SKIP = {"acuity_classifier", "csv_roundtrip", "vector_roundtrip"}


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = get_spark("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_connection(sf)
    for name, sql in ORACLE.items():
        if name in SKIP or name not in QUERIES:
            continue
        df = QUERIES[name](spark, sf)
        s_types = {f.name: SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        d_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        diff = {c: (s_types[c], d_types.get(c)) for c in s_types if s_types[c] != d_types.get(c)}
        if diff:
            print(name, diff)


if __name__ == "__main__":
    main()
