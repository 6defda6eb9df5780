"""Every operator as a query over the driver tables, next to equivalent SQL."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from crossfield.catalog import base, modelling, reports, rows, scoring  # noqa: F401

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "crossfield.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in root.rglob("*.py"):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def _ready(query: base.Query) -> base.Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf)
    return run


def queries() -> dict[str, base.Query]:
    return {name: _ready(query) for name, query in base.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return queries()["a19_nuclide_counts"](spark, sf)
