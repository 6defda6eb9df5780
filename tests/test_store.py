"""Shared results are found again, and missed after any change of input or settings."""

import os

import pytest
from pyspark.sql import functions as F

from crossfield.catalog import base
from crossfield.sources import store, tables


@pytest.fixture
def calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_root", lambda _: str(tmp_path / "results"))
    source, made = str(tmp_path / "source"), []
    spark.range(6).write.parquet(source)

    def ask(**settings):
        def build():
            made.append(settings)
            return spark.read.parquet(source).withColumn("k", F.col("id") * settings.get("by", 1))
        rows = store.shared_result(spark, "times", [source], settings, build)
        return len(made), sorted(r.k for r in rows.collect())

    return ask, source


def test_a_result_is_built_once(calls):
    ask, _ = calls
    assert ask(by=2) == (1, [0, 2, 4, 6, 8, 10]) and ask(by=2)[0] == 1


def test_a_changed_setting_misses(calls):
    ask, _ = calls
    assert ask(by=2)[0] == 1 and ask(by=3) == (2, [0, 3, 6, 9, 12, 15]) and ask(by=2)[0] == 2


def test_a_changed_input_misses(spark, calls):
    ask, source = calls
    ask()
    spark.range(6, 8).write.mode("append").parquet(source)
    assert ask() == (2, [0, 1, 2, 3, 4, 5, 6, 7])
    spark.range(3).write.mode("overwrite").parquet(source)
    assert ask() == (3, [0, 1, 2])
    for name in os.listdir(source):
        os.utime(os.path.join(source, name), (1, 1))
    assert ask()[0] == 4


def test_an_uncommitted_result_is_not_read(spark, calls, tmp_path):
    ask, source = calls
    path = f"{tmp_path}/results/times-{store.result_key(spark, 'times', [source], {})}"
    tables.begin_version(spark.range(1).withColumn("k", F.lit(99)), path)      # stopped before its commit
    assert ask() == (1, [0, 1, 2, 3, 4, 5]) and ask()[0] == 1


def test_reports_share_the_scored_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_root", lambda _: str(tmp_path / "results"))
    first, second = (base.scored(spark, "/root/testdata/sf0.001") for _ in range(2))
    assert first.inputFiles() == second.inputFiles() and first.count() == base.clean(spark, "/root/testdata/sf0.001").count()
