"""Neighbouring rows in an order, without sorting a hot group in one task.

A hot group is cut into tiles of equal size along the order; a tile is one window
partition. The rows just before a tile come from a table holding the last two
rows of every tile, which has a handful of rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield.plans.scale import TASK_ROWS, attach, group_sizes, materialize


def with_tiles(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], limit: int = TASK_ROWS,
               rank_as: str | None = None) -> DataFrame:
    """Add ``__tile``: 0 for ordinary groups, increasing along ``order`` in hot groups.

    Hot groups are range-sorted over the cluster; a row's exact rank is its place in its
    sorted partition plus the rows of its group in earlier partitions, and every ``limit``
    ranks make a tile. Ties in ``order`` are split like any other rows. ``rank_as`` keeps the
    rank (0-based) and ranks the ordinary groups too.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    sizes = group_sizes(df, keys, limit)
    if rank_as is None and sizes.bounded:
        return df.withColumn("__tile", F.lit(0))
    ordinary, hot = (None, df) if rank_as else sizes.split(df)
    by = [*keys, *order, "__tie"]
    ranged = hot.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    parts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    # One row per group and sorted partition.
    ahead = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__c")
    placed = attach(ranged, parts.select(*keys, "__part", "__first", ahead.alias("__ahead")), [*keys, "__part"])
    rank = F.col("__ahead") + F.col("__at") - F.col("__first")
    hot = placed.withColumns({"__tile": F.floor(rank / F.lit(limit)).cast("int"), **({rank_as: rank} if rank_as else {})})
    hot = hot.drop("__tie", "__at", "__part", "__first", "__ahead")
    return hot if ordinary is None else ordinary.withColumn("__tile", F.lit(0)).unionByName(hot)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    limit: int = TASK_ROWS,
) -> DataFrame:
    """Add structs ``prev1`` and ``prev2``: the values one and two rows earlier."""
    keys, order = list(keys), list(order)
    tiled = with_tiles(df, keys, order, limit)
    part = keys + ["__tile"]
    window = Window.partitionBy(*part).orderBy(*order)
    payload = F.struct(*[F.col(v).alias(v) for v in dict.fromkeys([*order, *values])])
    ranked = tiled.select(
        "*", payload.alias("__row"), F.row_number().over(window).alias("__rn"))
    ranked = ranked.select(
        "*", F.lag("__row", 1).over(window).alias("prev1"), F.lag("__row", 2).over(window).alias("prev2"))
    if tiled.select("__tile").filter("__tile > 0").isEmpty():
        return ranked.drop("__row", "__rn", "__tile")

    # Last two rows per tile, then the two rows before each tile's first row.
    last = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    tails = tiled.select(*part, payload.alias("__row"), F.row_number().over(last).alias("__back"))
    tails = materialize(tails.filter("__back <= 2"))
    along = Window.partitionBy(*keys).orderBy("__tile", F.col("__back").desc())
    halo = tails.select(
        *part, "__back",
        F.lag("__row", 1).over(along).alias("__h1"), F.lag("__row", 2).over(along).alias("__h2"),
        F.max("__back").over(Window.partitionBy(*part)).alias("__deepest"),
    ).filter("__back = __deepest").select(*part, "__h1", "__h2")
    joined = attach(ranked, halo, part)
    first, second = F.col("__rn") == 1, F.col("__rn") == 2
    return joined.withColumns({
        "prev1": F.when(first, F.col("__h1")).otherwise(F.col("prev1")),
        "prev2": F.when(first, F.col("__h2")).when(second, F.col("__h1")).otherwise(F.col("prev2")),
    }).drop("__row", "__rn", "__tile", "__h1", "__h2")
