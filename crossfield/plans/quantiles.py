"""Exact linear-interpolated percentiles per group, at any group size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. That is
the right plan while groups are small. For a hot key the same number is found by
narrowing: count rows in equal-width cells between the group's minimum and maximum
(a plain aggregation with map-side combine), keep only the cell holding the wanted
rank, and repeat until that cell is small. No row is approximated or dropped, and no
task ever holds more than ``limit`` rows of one key's range, ties of one value apart.

Cells are equal steps of the logarithm while a range spans more than a factor of two, then
equal steps of the value, and signs are parted first, so the widest range of doubles is
settled within ``MAX_ROUNDS``. Infinities and NaN (largest, as Spark orders it) are counted
apart: a rank among them needs no narrowing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield.plans.scale import GroupSizes, checked_broadcast, group_sizes, materialize

CELLS = 4096
MAX_ROUNDS = 30
# Rows of a key up to which one hash map of its values is the better plan.
PERCENTILE_ROWS = 1_000_000


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    limit: int = PERCENTILE_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """One row per key with a column per named probability (NULL values are ignored).

    ``sizes`` reuses counts taken before over the same keys.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    sizes = sizes or group_sizes(data, keys, limit)
    if sizes.bounded:
        return _by_aggregate(data, keys, probabilities)
    ordinary, hot = sizes.split(data)
    return _by_aggregate(ordinary, keys, probabilities).unionByName(
        _by_narrowing(hot, keys, probabilities, limit)
    )


def table_percentiles(
    df: DataFrame, value: str, probabilities: dict[str, float], limit: int = PERCENTILE_ROWS, rows: int | None = None,
) -> DataFrame:
    """Percentiles of a whole column: always one key, so the size decides the plan.

    ``rows`` is the number of values if the caller has counted them; it spares a scan.
    """
    keyed, sizes = df.withColumn("__all", F.lit(1)), None
    if rows is not None:
        table = df.sparkSession.createDataFrame([(1, rows)], "__all int, group_rows long")
        sizes = GroupSizes(table, ["__all"], limit, rows)
    return group_percentiles(keyed, ["__all"], value, probabilities, limit, sizes=sizes).drop("__all")


def column_percentiles(
    df: DataFrame, columns: Mapping[str, Column | str], probabilities: dict[str, float],
    limit: int = PERCENTILE_ROWS, counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row with ``<name>__<probability>`` for several columns of a table.

    A column is a key of ``group_percentiles``: one scan counts the values of all columns and
    one more finds all percentiles; long columns narrow together, a scan for each round.
    NULL values are ignored, a column without values is NULL. ``counts`` of values that
    the caller knows spare the first scan.
    """
    names = list(columns)
    each = [F.struct(F.lit(i).alias("__column"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("__v"))
            for i, c in enumerate(columns.values())]
    stacked = df.select(F.inline(F.array(*each))).filter(F.col("__v").isNotNull())
    sizes = None
    if counts is not None:
        known = [(i, int(counts[name])) for i, name in enumerate(names)]
        table = df.sparkSession.createDataFrame(known, "__column int, group_rows long")
        sizes = GroupSizes(table, ["__column"], limit, max(n for _, n in known))
    found = group_percentiles(stacked, ["__column"], "__v", probabilities, limit, sizes=sizes)
    return found.agg(*[
        F.max(F.when(F.col("__column") == i, F.col(p))).alias(f"{name}__{p}")
        for i, name in enumerate(names) for p in probabilities])


def _by_aggregate(data: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    array = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probabilities.values()]))
    packed = data.groupBy(*keys).agg(array.alias("__p"))
    return packed.select(
        *keys, *[F.col("__p")[i].alias(name) for i, name in enumerate(probabilities)]
    )


def _by_narrowing(
    data: DataFrame, keys: list[str], probabilities: dict[str, float], limit: int
) -> DataFrame:
    """Shrink, per wanted rank, a value range [lo, hi] of m rows until m is small."""
    finite = ~F.isnan("__v") & (F.abs("__v") < float("inf"))
    spans = data.groupBy(*keys).agg(
        F.min(F.when(finite, F.col("__v"))).alias("__lo"), F.max(F.when(finite, F.col("__v"))).alias("__hi"),
        F.count(F.lit(1)).alias("__n"), F.count_if(finite).alias("__m"),
        F.count_if(F.col("__v") == float("-inf")).alias("__under"), F.count_if(F.col("__v") == float("inf")).alias("__over"))
    # Every percentile lies between two neighbouring order statistics (0-based ranks).
    position = {i: F.lit(float(p)) * (F.col("__n") - 1) for i, p in enumerate(probabilities.values())}
    wanted = F.array(*[
        F.struct(F.lit(i).alias("__target"), F.lit(side).alias("__side"), (at - F.floor(at)).alias("__f"),
                 rank(at).cast("long").alias("__rank"))
        for i, at in position.items() for side, rank in ((0, F.floor), (1, F.ceil))
    ])
    ranked = spans.select("*", F.inline(wanted))
    upto = F.col("__under") + F.col("__m")
    fixed = F.when(F.col("__rank") < F.col("__under"), float("-inf")).when(
        F.col("__rank") < upto, None).when(F.col("__rank") < upto + F.col("__over"), float("inf")).otherwise(float("nan"))
    # A rank among infinities or NaN is a range of that single value.
    frontier = materialize(ranked.withColumn("__x", fixed).select(
        *keys, F.coalesce("__x", "__lo").alias("__lo"), F.coalesce("__x", "__hi").alias("__hi"), "__m",
        "__target", "__side", "__f", (F.col("__rank") - F.col("__under")).alias("__rank")))
    open_range = (F.col("__m") > limit) & (F.col("__lo") < F.col("__hi"))
    for _ in range(MAX_ROUNDS):
        if frontier.filter(open_range).isEmpty():
            break
        narrowed = _narrow(data, keys, frontier.filter(open_range))
        frontier = materialize(frontier.filter(~open_range).unionByName(narrowed))
    else:
        raise RuntimeError("percentile ranges did not narrow")

    found = _pick(data, keys, frontier)
    sides = found.groupBy(*keys, "__target", "__f").agg(
        F.max(F.when(F.col("__side") == 0, F.col("__x"))).alias("__a"),
        F.max(F.when(F.col("__side") == 1, F.col("__x"))).alias("__b"))
    value = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(
        (1 - F.col("__f")) * F.col("__a") + F.col("__f") * F.col("__b"))
    return sides.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__target") == i, value)).alias(name) for i, name in enumerate(probabilities)])


def _renamed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """The table with ``columns`` renamed, and null-safe equality with the original names."""
    other = {c: f"__r_{c}" for c in columns}
    equal = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in other.items()])
    return df.withColumnsRenamed(other), equal


def _in_ranges(data: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """Rows whose value lies in one of their key's ranges (a few per key, so broadcast)."""
    ranges, same = _renamed(ranges, keys)
    inside = same & F.col("__v").between(F.col("__lo"), F.col("__hi"))
    return data.join(checked_broadcast(ranges), inside).select(*keys, "__v", "__lo", "__hi")


def _covering(counted: DataFrame, span: list[str], order: str) -> DataFrame:
    """Add the number of rows before (``__before``) and up to (``__upto``) each counted step."""
    upto = F.sum("__c").over(Window.partitionBy(*span).orderBy(order))
    return counted.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__c"))


def _at_rank(steps: DataFrame, targets: DataFrame, span: list[str]) -> DataFrame:
    """Join every target to the step that holds its rank."""
    wanted, same = _renamed(targets.select(*span, "__target", "__side", "__f", "__rank"), span)
    held = (F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__upto"))
    return steps.join(checked_broadcast(wanted), same & held)


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Where a value lies in its range, 0 at ``lo`` and 1 at ``hi``, never falling in between."""
    near = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    up = (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo))
    down = (F.log(-lo) - F.log(-v)) / (F.log(-lo) - F.log(-hi))
    by_sign = F.when(v < 0, 0.0).when(v == 0, 0.5).otherwise(1.0)
    straddles = (lo < 0) & (hi >= 0) | (lo == 0)
    return F.when(straddles, by_sign).when((lo > 0) & (hi / 2 > lo), up).when((hi < 0) & (lo / 2 < hi), down).otherwise(near)


def _narrow(data: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """One pass: count equal-width cells of each open range, keep the cell of each rank."""
    span = [*keys, "__lo", "__hi"]
    rows = _in_ranges(data, keys, targets.select(*span).distinct())
    share = _share(F.col("__v"), F.col("__lo"), F.col("__hi"))
    cells = rows.groupBy(*span, F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("__cell")).agg(
        F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__first"), F.max("__v").alias("__last"))
    steps = _covering(cells, span, "__cell")
    return _at_rank(steps, targets, span).select(
        *keys, F.col("__first").alias("__lo"), F.col("__last").alias("__hi"), F.col("__c").alias("__m"),
        "__target", "__side", "__f", (F.col("__rank") - F.col("__before")).alias("__rank"))


def _pick(data: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """The value at each rank once its range is small or holds a single value."""
    span = [*keys, "__lo", "__hi"]
    flat = F.col("__lo") == F.col("__hi")
    rows = _in_ranges(data, keys, targets.filter(~flat).select(*span).distinct())
    tied = rows.groupBy(*span, "__v").agg(F.count(F.lit(1)).alias("__c"))
    steps = _covering(tied, span, "__v")
    picked = _at_rank(steps, targets.filter(~flat), span).select(
        *keys, "__target", "__side", "__f", F.col("__v").alias("__x"))
    return picked.unionByName(targets.filter(flat).select(*keys, "__target", "__side", "__f", F.col("__lo").alias("__x")))
