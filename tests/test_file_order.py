"""Row numbers in file order, at any split size."""

import pytest
from pyspark.sql import functions as F

from edspark.operators.decisions import fairness_input
from edspark.sources import fixed_width as fw


@pytest.fixture
def folder(tmp_path):
    lines = {"a.txt": [f"a{i:05d}" + "x" * (i % 90) for i in range(3000)], "b.txt": ["only"], "c.txt": [], "d.txt": [f"d{i}" for i in range(5000)]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
    return str(tmp_path), [(r, i) for name in sorted(lines) for i, r in enumerate(lines[name])]


@pytest.mark.parametrize("split", ["128m", "3000b", "700b"])
def test_numbers_are_gapless_at_any_split_size(spark, folder, split):
    path, lines = folder
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    try:
        read = spark.read.text(path)
        if split != "128m":
            assert read.rdd.getNumPartitions() > 10
        got = fw.number_rows(read, "row_id", "line_no").orderBy("row_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r["value"], r["line_no"]) for r in got] == lines
    assert [r["row_id"] for r in got] == list(range(len(lines)))


def test_csv_rows_and_the_fairness_join(spark, tmp_path):
    """Results are aligned by place; the shorter side ends the join."""
    visits = spark.createDataFrame([(i, float(i % 6) or None, 10.0 * (i % 9)) for i in range(40)], "i int, ESI double, Age double").coalesce(1)
    visits.sortWithinPartitions("i").write.option("header", True).csv(str(tmp_path / "visits"))
    results = spark.createDataFrame([(i, 9, i % 5, i % 7 == 0) for i in range(25)], "i int, ESI int, Final_Action int, Is_Critical_Miss boolean").coalesce(1)
    results.sortWithinPartitions("i").write.option("header", True).csv(str(tmp_path / "results"))
    numbered = [fw.number_rows(spark.read.option("header", True).schema(s).csv(str(tmp_path / n)), "row_id") for n, s in (
        ("visits", "i int, ESI double, Age double"), ("results", "j int, ESI int, Final_Action int, Is_Critical_Miss boolean"))]
    out = fairness_input(*numbered).orderBy("row_id").collect()
    assert [(r.row_id, r.i, r.j, r.ESI) for r in out] == [(i, i, i, float(i % 6)) for i in range(25) if i % 6]
    assert {r.Gender_Label for r in out} == {"Unknown"}


def test_read_fixed_numbers_its_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text("".join(f"{i:010d}{i % 100:4d}" + " " * 180 + "\n" for i in range(50)))
    got = fw.read_fixed(spark, str(tmp_path / "v.txt"), row_id="n").orderBy("n").collect()
    assert [(r.n, r.Age) for r in got] == [(i, float(i % 100)) for i in range(50)]
    assert fw.number_rows(spark.read.text(str(tmp_path / "v.txt")).filter(F.lit(False))).count() == 0
