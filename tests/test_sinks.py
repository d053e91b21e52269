import pytest
from pyspark.sql import functions as F

from moltables.operators.features import grouped_cv
from moltables.operators.structure import farthest_pair
from moltables.sources import sinks
from moltables.sources.tables import read_required_csv


def test_required_columns(spark, write):
    p = write("ti.csv", "lambda,mean_dvdl,sem_dvdl\n0.0,1.0,0.1\n0.5,,0.1\n1.0,3.0,0.2\n")
    d = read_required_csv(spark, p, "lambda double, mean_dvdl double, sem_dvdl double", ["lambda", "mean_dvdl"])
    assert sorted(r["lambda"] for r in d.collect()) == [0.0, 1.0]
    with pytest.raises(ValueError):
        read_required_csv(spark, p, "x double", ["x"])


def test_writers(spark, tmp_path):
    d = spark.range(25).select(F.format_string("f%03d", "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"), (F.col("id") % 3).alias("k"))
    sinks.compact_files(d.drop("k"), str(tmp_path / "pack"), per_package=10)
    sizes = sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "pack")).groupBy("package").count().collect())
    assert sizes == [5, 10, 10]
    sinks.write_by_key(d.drop("content"), str(tmp_path / "by"), ["k"])
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"k=0", "k=1", "k=2"}
    sinks.write_delimited(d.select("path", "k"), str(tmp_path / "csv"), sep="\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "csv")).count() == 25
    sinks.write_lines(d.select(F.col("path").alias("value"), "path"), str(tmp_path / "txt"), ["path"])
    parts = sorted((tmp_path / "txt").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f"f{i:03d}" for i in range(25)]


def test_farthest_pair_without_keys(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0), (2, 1.0, 1.0, 1.0)], "n int, x double, y double, z double")
    r = farthest_pair(d, [], "n").first()
    assert (r["i"], r["j"], r["distance"]) == (0, 1, 5.0)


def test_network_classifier_under_grouped_folds(spark):
    rows = [(f"r{i % 6}", "a" if i % 2 else "b", float(i % 2) * 3 + (i % 5) * 0.1, float(i % 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "replicate string, y string, res_1 double, res_2 double")
    accs, w = grouped_cv(d, ["res_1", "res_2"], "y", "replicate", classifier="network")
    assert len(accs) == 3 and w is None and min(accs) > 0.8
