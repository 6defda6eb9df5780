"""Parquet loads and writes of measurement tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crossfield.operators.select import Selection
from crossfield.schema import ESSENTIAL_COLUMNS

PREVIEW_ROWS = 1000


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def scan_optional(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Required columns plus whichever optional ones the table has."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df.select(*required, *existing(df, optional))


def load_measurements(
    spark: SparkSession, path: str, selection: Selection | None = None, preview: bool = False,
    columns: Sequence[str] = ESSENTIAL_COLUMNS,
) -> DataFrame:
    """Scan a file or a partitioned folder; only needed columns and row groups are read.

    Filters see every column they use; columns are cut afterwards, and Catalyst moves both
    into the scan.
    """
    return select_measurements(spark.read.parquet(current_folder(spark, path)), selection, preview, columns)


def select_measurements(
    raw: DataFrame, selection: Selection | None = None, preview: bool = False,
    columns: Sequence[str] = ESSENTIAL_COLUMNS,
) -> DataFrame:
    rows = selection.apply(raw)[0] if selection else raw
    rows = rows.select(*existing(rows, columns))
    return rows.limit(PREVIEW_ROWS) if preview else rows


def write_measurements(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet folder.

    With partition columns, rows are rebalanced by them: adaptive execution gathers small
    keys and cuts a key with most of the rows into tasks (and files) of the advised size,
    so it is neither one task nor ten thousand small files.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def partition_report(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """How many directories a partitioned write makes and how full they are."""
    per_key = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("rows"),
        F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))


def write_with_report(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """A partitioned write and its report, without computing the rows twice.

    The rows are counted by the write itself. Directories are counted from what was written: a
    count by partition columns alone reads file footers, no column.
    """
    written = Observation()
    write_measurements(df.observe(written, F.count(F.lit(1)).alias("rows")), path, partition_by)
    report = partition_report(df.sparkSession.read.schema(df.schema).parquet(path), partition_by)
    # An empty plan is planned away with its observation.
    rows = written.get["rows"] if report.first()["partitions"] else 0
    return report.withColumn("rows", F.lit(rows).cast("long"))


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def replace_with(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Write next to a table and swap the folders: never overwrite what is being read.

    Between the two renames no table stands at the path; a swap that stopped there is undone
    by the next. ``begin_version`` and ``commit_version`` have no such moment.
    """
    fs, target = _files(spark, path)
    fresh, old = _files(spark, path + ".new")[1], _files(spark, path + ".old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)
    write_measurements(df, path + ".new")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(old, True)


# A versioned table is a folder of numbered folders. Version n counts once the empty file
# committed-n exists, which one call creates; readers take the highest such n.
_VERSION, _COMMITTED = "version-", "committed-"


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def begin_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write rows as the next version of a table. Readers keep the present one until ``commit_version``."""
    spark = df.sparkSession
    number = max([0, *_numbers(spark, path, _VERSION), *_numbers(spark, path, _COMMITTED)]) + 1
    write_measurements(df, f"{path}/{_VERSION}{number}", partition_by)
    return number


def commit_version(spark: SparkSession, path: str, number: int) -> None:
    """Make a written version the present one, in one step."""
    if number not in _numbers(spark, path, _VERSION):
        raise ValueError(f"{path} has no version {number}")
    fs, marker = _files(spark, f"{path}/{_COMMITTED}{number}")
    if not fs.createNewFile(marker):
        raise OSError(f"version {number} of {path} is committed already")


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder of the present version; the path itself for a plain table."""
    committed = _numbers(spark, path, _COMMITTED)
    return f"{path}/{_VERSION}{committed[-1]}" if committed else path


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the last ``keep`` committed versions, and what stopped before its commit.

    A version written after the present one stays: it may be about to be committed.
    """
    committed = _numbers(spark, path, _COMMITTED)
    if not committed:
        return []
    kept = set(committed[-keep:])
    gone = [n for n in _numbers(spark, path, _VERSION) if n < committed[-1] and n not in kept]
    for n in gone:
        for name in (_COMMITTED, _VERSION):  # the marker first, so that it never names a missing folder
            fs, entry = _files(spark, f"{path}/{name}{n}")
            fs.delete(entry, True)
    return gone


def export_subset(spark: SparkSession, source: str, target: str, selection: Selection) -> None:
    """Keep the filtered rows of a table for repeated use."""
    write_measurements(load_measurements(spark, source, selection), target)


def save_json(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    """A small state (scaler statistics, experiment properties) as one JSON line."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])
