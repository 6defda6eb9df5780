"""Connected components of a link table by alternating star steps.

Nodes are values of any ordered type. No node's links are gathered: a step is a minimum
per node (combined before the shuffle) joined back to the links, that of a node with many
links by broadcast (``spread_join``), so the centre of a large star is no task's own. Links end as stars around
the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield.llm.common import materialize, spread_join

MAX_STEPS = 60


def _measure(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; a NULL or equal end is ignored)."""
    links = materialize(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _measure(links)
    for _ in range(MAX_STEPS):
        if not seen[0]:
            break
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("links")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"), "links")
        # Larger neighbours point to the smallest neighbour.
        large = spread_join(both.filter(F.col("b") > F.col("a")), least, "a", "n", "links", 2 * seen[0]).select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        large = materialize(large, "large-star")
        # Smaller neighbours and the node itself point to the smallest neighbour.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "n")
        small = spread_join(large, low, "a", "n", "links", large.count()).select(
            F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(
            F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        links = materialize(small, "small-star")
        now = _measure(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
