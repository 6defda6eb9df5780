"""Versioned tables, write reports, and splits by key."""

import pytest
from pyspark.sql import functions as F

from crossfield.operators import models
from crossfield.sources import tables


def ids(df):
    return sorted(r["Z"] for r in df.collect())


@pytest.fixture
def rows(spark):
    return spark.range(6).select(F.col("id").cast("int").alias("Z"), F.lit(1.0).alias("Energy"))


def test_a_version_counts_from_its_commit_on(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    first = tables.begin_version(rows, path)
    tables.commit_version(spark, path, first)
    before = tables.load_measurements(spark, path)
    second = tables.begin_version(before.filter("Z > 3"), path)       # reads what it replaces
    assert ids(tables.load_measurements(spark, path)) == [0, 1, 2, 3, 4, 5]
    tables.commit_version(spark, path, second)
    assert ids(tables.load_measurements(spark, path)) == [4, 5] and ids(before) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(OSError):
        tables.commit_version(spark, path, second)
    with pytest.raises(ValueError):
        tables.commit_version(spark, path, 9)


def test_a_write_that_stopped_is_passed_over_and_cleaned(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    tables.commit_version(spark, path, tables.begin_version(rows, path))
    tables.begin_version(rows.filter("Z = 1"), path)                  # never committed
    third = tables.begin_version(rows.filter("Z = 2"), path)
    assert third == 3
    tables.commit_version(spark, path, third)
    waiting = tables.begin_version(rows.filter("Z = 3"), path)
    assert tables.drop_old_versions(spark, path) == [1, 2]
    assert ids(tables.load_measurements(spark, path)) == [2]
    tables.commit_version(spark, path, waiting)
    assert ids(tables.load_measurements(spark, path)) == [3]
    assert tables.drop_old_versions(spark, str(tmp_path / "none")) == []


def test_a_plain_folder_is_its_own_version(spark, rows, tmp_path):
    path = str(tmp_path / "plain")
    tables.write_measurements(rows, path)
    assert tables.current_folder(spark, path) == path and len(ids(tables.load_measurements(spark, path))) == 6


def test_a_swap_that_stopped_is_undone_by_the_next(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    tables.write_measurements(rows, path + ".old")                    # target moved aside, then stopped
    tables.replace_with(rows.filter("Z < 2"), path, spark)
    assert ids(spark.read.parquet(path)) == [0, 1] and not (tmp_path / "s.old").exists()


def test_report_of_a_write(spark, rows, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = rows.withColumn("MT", F.col("Z") % 2).mapInArrow(counted, "Z int, Energy double, MT int")
    report = tables.write_with_report(df, str(tmp_path / "r"), ["MT"]).first()
    assert (report.partitions, report.rows, report.min_rows, report.max_rows) == (2, 6, 3, 3) and calls.value == 6
    empty = tables.write_with_report(rows.filter("Z < 0"), str(tmp_path / "e"), ["Z"]).first()
    assert (empty.partitions, empty.rows) == (0, 0)


def test_folds_follow_the_key(spark):
    df = models.with_folds(spark.range(60).withColumn("k", F.when(F.col("id") > 0, F.col("id") - 30)), F.col("k"), 3)
    got = df.collect()
    assert all(r.fold == (r.k or 0) % 3 and 0 <= r.draw < models.DRAWS for r in got)
