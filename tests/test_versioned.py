"""Stored tables whose versions switch at once."""

import pathlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from verdigris.sources.versioned import ConflictError, VersionedTable


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in pathlib.Path(folder).rglob("*.parquet")}


def test_append_widens_and_keeps_old_files(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.schema() is None
    assert table.append(spark.createDataFrame([(1, "a"), (2, None)], "k INT, v STRING")) == 1
    before = files(tmp_path)
    assert table.append(spark.createDataFrame([(True, 3), (None, None)], "extra BOOLEAN, k INT")) == 2
    assert {p: s for p, s in files(tmp_path).items() if p in before} == before
    assert table.read().columns == ["k", "v", "extra"]
    assert rows(table.read()) == rows(spark.createDataFrame([(1, "a", None), (2, None, None), (3, None, True), (None, None, None)], "k INT, v STRING, extra BOOLEAN"))
    assert rows(table.read(1)) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="k is int"):
        table.append(spark.createDataFrame([("x",)], "k STRING"))
    assert table.version() == 2


def test_a_broken_write_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(spark.range(5).select(F.col("id").alias("k")))
    bad = spark.range(100).select(F.when(F.col("id") == 97, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("k"))
    with pytest.raises(Exception, match="broken"):
        table.append(bad)
    assert table.version() == 1 and rows(table.read()) == [(k,) for k in range(5)]
    assert table.clean() == 1 and rows(table.read()) == [(k,) for k in range(5)]  # what the broken write left


def test_truncate_keeps_schema_and_older_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([(1, "a")], "k INT, v STRING"))
    table.truncate()
    assert table.read().columns == ["k", "v"] and table.read().count() == 0 and table.read(1).count() == 1
    table.append(spark.createDataFrame([(9, "z")], "k INT, v STRING"))
    assert rows(table.read()) == [(9, "z")]
    assert table.clean() == 1 and rows(table.read()) == [(9, "z")] and table.version() == 3


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.append(spark.range(1).select(F.col("id").alias("k")))
    base = two.version()
    one.append(spark.range(2).select(F.col("id").alias("k")))
    with pytest.raises(ConflictError):
        two._switch(base, two.manifest(base))
    assert one.version() == 2 and one.read().count() == 3
