"""Columns that are worked out once a row.

Catalyst merges a chain of projections and pushes filters through them, which
copies a derived column into every place that names it: a parse of JSON is
then done once per use.  A generated column stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, each worked out once a row."""
    if len(columns) == 1:
        ((name, column),) = columns.items()
        return df.select("*", F.explode(F.array(column)).alias(name))
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
