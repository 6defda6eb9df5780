"""Results that several reports share, computed once and found again by their key.

A result is stored under a hash of its name, its settings and its input files (path, length and
time of change), so a changed setting or file gives another key and is computed anew. It is a
versioned table: readers see it only after its one-step commit, and what a lost run left
without a commit is not read.

``crossfield.store.dir`` names a shared folder that outlives the application. Without it,
results lie beside the checkpoints and are shared within the application.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from crossfield.plans.scale import new_folder
from crossfield.sources.tables import _files, begin_version, commit_version, current_folder

STORE_DIR = "crossfield.store.dir"
# To be raised when a stored operator changes its result.
FORMAT = 1
_own_folders: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    folder = spark.conf.get(STORE_DIR, None)
    if folder:
        return folder
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = new_folder(spark, "results")
    return _own_folders[application]


def input_state(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """Path, length and time of change of every file below the paths, from listings alone."""
    found = []
    for path in paths:
        fs, folder = _files(spark, current_folder(spark, path))
        files = fs.listFiles(folder, True)
        while files.hasNext():
            entry = files.next()
            found.append((entry.getPath().toString(), entry.getLen(), entry.getModificationTime()))
    return sorted(found)


def result_key(spark: SparkSession, name: str, inputs: Sequence[str], settings: dict[str, Any]) -> str:
    content = [FORMAT, spark.version, name, input_state(spark, inputs), settings]
    return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()


def shared_result(
    spark: SparkSession, name: str, inputs: Sequence[str], settings: dict[str, Any], build: Callable[[], DataFrame],
) -> DataFrame:
    """The stored result for these inputs and settings; built and stored if there is none.

    ``settings`` must name everything but the inputs that the result depends on.
    """
    path = f"{_root(spark)}/{name}-{result_key(spark, name, inputs, settings)}"
    if current_folder(spark, path) == path:
        commit_version(spark, path, begin_version(build(), path))
    return spark.read.parquet(current_folder(spark, path))
