"""A corpus pipeline over ``documents``: each stage is one operator of ``crossfield.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossfield.catalog import ship_package
from crossfield.llm import bpe, line_dedup, mixing, quality_rules, simhash
from crossfield.llm.common import new_path

# Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

# The near-duplicate stage (XXH64, components) and the encoding are not SQL;
# tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read back."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
