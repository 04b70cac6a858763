"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edspark.session import ensure_checkpoint_dir

#: Characters that end a word: space and the control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a session, so
    that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_edspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="edspark-ship-"), "edspark_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._edspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """A column name for each of ``names`` that clashes with none of
    ``taken`` (names compare without case, as Spark resolves them)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null ids count as the
    empty text): the documented hold-out rule."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % divisor


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the
    lineage, and every reader sees the same rows even if an executor is
    lost."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session_partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is set to."""
    value = spark.conf.get("spark.sql.shuffle.partitions", None)
    return max(1, int(value)) if value and value.isdigit() else spark.sparkContext.defaultParallelism
