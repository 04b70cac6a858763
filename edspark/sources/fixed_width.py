"""Fixed-width survey ingest.

A layout is data: a list of ``(name, start, end, scale)`` with Python-style
``[start:end)`` offsets.  Parsing is one projection over ``spark.read.text``,
so it is split-parallel and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edspark.functions.text import clean_num, extract_codes, join_codes
from edspark.operators.sequence import small_side
from edspark.schemas import CODES_FROM, LAYOUT_A
from edspark.session import ensure_checkpoint_dir

Layout = Sequence[tuple[str, int, int, float]]


def slice_field(line: Column, start: int, end: int) -> Column:
    """``line[start:end]`` (Spark substring is 1-based; short lines give '')."""
    return F.substring(line, start + 1, end - start)


def parse_lines(lines: DataFrame, layout: Layout = LAYOUT_A, value_col: str = "value",
                codes_from: int = CODES_FROM, keep: Sequence[str] = ()) -> DataFrame:
    """S1 body: one output row per input line with every layout field parsed
    (P2/P3) and the diagnosis codes after ``codes_from`` joined (X1/X2)."""
    line = F.col(value_col)
    fields = [clean_num(slice_field(line, s, e), scale).alias(name) for name, s, e, scale in layout]
    codes = join_codes(extract_codes(F.substring(line, codes_from + 1, 1 << 30)))
    return lines.select(*keep, *fields, codes.alias("Chief_complain"))


def read_fixed(spark: SparkSession, path: str | Sequence[str], layout: Layout = LAYOUT_A, row_id: str | None = None) -> DataFrame:
    """Scan fixed-width text files (one record per line) and parse them;
    with ``row_id`` every row has its number in file order (J5/T8)."""
    if row_id is None:
        return parse_lines(spark.read.text(path), layout)
    return parse_lines(number_rows(spark.read.text(path), row_id), layout, keep=[row_id])


def number_rows(rows: DataFrame, row_id: str = "row_id", line_no: str | None = None) -> DataFrame:
    """The rows of a file scan (text or CSV) with ``row_id``, their
    number from 0 in the order of paths and lines, and, if named, ``line_no``,
    the number within the file.

    Spark reads a file in splits, each in order.  A first pass counts the rows
    of every split (file, start); running totals give each split its first
    number, and the rows follow by their place in the split.  The table of
    splits is counted and broadcast only up to a stated number of rows.  Both
    passes read the same splits, as these depend on the files and the settings
    alone; a row of a split that the first pass did not meet raises an error."""
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"),
                     F.monotonically_increasing_id().alias("__place"))
    splits = at.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select(F.col("__file").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__skip"))
    inside = Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    first = splits.withColumn("__skip_in_file", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    first = first.join(files, F.col("__file") == F.col("__of")).select(
        F.col("__file").alias("__sfile"), F.col("__split").alias("__ssplit"), "__first", "__skip", "__skip_in_file")
    ensure_checkpoint_dir(rows.sparkSession)
    numbered = at.join(small_side(first), (F.col("__file") == F.col("__sfile")) & (F.col("__split") == F.col("__ssplit")), "left")
    place = F.when(F.col("__first").isNull(), F.raise_error(F.lit("the files changed while they were numbered"))).otherwise(
        F.col("__skip_in_file") + F.col("__place") - F.col("__first"))
    numbers = [(F.col("__skip") + place).cast("bigint").alias(row_id)] + ([place.cast("bigint").alias(line_no)] if line_no else [])
    return numbered.select(*numbers, *[F.col(f"`{c}`") for c in rows.columns])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def union_years(frames: Mapping[int, DataFrame]) -> DataFrame:
    """Tag each yearly frame with ``Year`` and union by name (columns
    missing in one year become null)."""
    out = None
    for year, frame in frames.items():
        tagged = frame.withColumn("Year", F.lit(int(year)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no yearly input")
    return out


def read_years(spark: SparkSession, paths: Mapping[int, str], layout: Layout = LAYOUT_A) -> DataFrame:
    """Read each year's file that exists (missing paths are skipped),
    parse, tag with the year and union."""
    present = {y: p for y, p in paths.items() if path_exists(spark, p)}
    return union_years({y: read_fixed(spark, p, layout) for y, p in present.items()})


def valid_esi(visits: DataFrame, col: str = "ESI", low: int = 1, high: int = 5) -> DataFrame:
    """Drop null targets and keep ``low <= ESI <= high``."""
    return visits.filter(F.col(col).isNotNull() & F.col(col).between(low, high))


def parse_report(visits: DataFrame, target: str = "ESI", low: int = 1, high: int = 5) -> DataFrame:
    """P4-P6 counts in one aggregate: lines parsed, lines whose target did not
    parse (dropped), lines out of range (dropped) and lines kept."""
    t = F.col(target)
    return visits.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(t.isNull()).alias("n_missing_target"),
        F.count_if(t.isNotNull() & ~t.between(low, high)).alias("n_out_of_range"),
        F.count_if(t.isNotNull() & t.between(low, high)).alias("n_kept"))
