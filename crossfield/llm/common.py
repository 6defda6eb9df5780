"""Helpers shared by the text operators: shared-folder tables, words, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only under a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _LOCAL_FOLDERS.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, with null read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, JVM-side."""
    return F.array_remove(F.split(text, GAP), "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body`` (a let-expression)."""
    return F.transform(F.array(value), body)[0]


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by name, ignoring case, so that added columns never clash."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


# A key is hot with more than 1/500 of the rows, and never with 16 or fewer: there are
# fewer than 500 such keys, however large the table.
HOT_PARTS, COLD_ROWS = 500, 16


def spread_join(rows: DataFrame, facts: DataFrame, key: str, fact_key: str, count: str, total: int) -> DataFrame:
    """Inner join with one fact row per key, which knows in ``count`` how many of ``total`` rows have it.

    Facts of hot keys are broadcast (at most 500 rows), so that their rows stay where they are;
    the others are joined by shuffle. ``count`` is dropped.
    """
    hot = F.col(count) > F.lit(max(total // HOT_PARTS, COLD_ROWS))
    known = F.broadcast(facts.filter(hot).drop(count))
    on = F.col(key) == F.col(fact_key)
    rest = rows.join(F.broadcast(facts.filter(hot).select(fact_key)), on, "left_anti")
    return rows.join(known, on).unionByName(rest.join(facts.filter(~hot).drop(count), on))
