"""Order, top-k, sampling and vector neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.plans.scale import materialize

# Equal cells in which the draws of a sample are counted.
DRAW_CELLS = 4096


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str], largest: bool = True) -> DataFrame:
    order = F.col(by).desc() if largest else F.col(by)
    return df.orderBy(order, *ties).limit(k)


def best_candidate(
    candidates: DataFrame, keys: Sequence[str], library: str, neutron_sublibrary: int = 10
) -> DataFrame:
    """First candidate per key: wanted library and neutron data, then library, then neutron.

    The smallest (priority, position) wins, an aggregation with map-side combine.
    """
    exact, neutron = F.col("library") == library, F.col("sublibrary") == neutron_sublibrary
    priority = F.when(exact & neutron, 0).when(exact, 1).when(neutron, 2).otherwise(3)
    usable = candidates.filter(F.col("section_id").isNotNull())
    others = [c for c in candidates.columns if c not in keys]
    best = usable.groupBy(*keys).agg(F.min_by(
        F.struct(*others, priority.alias("priority")), F.struct(priority, F.col("position"))).alias("b"))
    return best.select(*keys, "b.*")


def overlay_curve(df: DataFrame, energy: str = "Energy", value: str = "CrossSection") -> DataFrame:
    kept = df.filter((F.col(energy) > 0) & (F.col(value) > 0))
    return kept.withColumns({"log_E": F.log10(energy), "log_sigma": F.log10(value)})


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_fold(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _doubles(a), _doubles(b)
    dot = _fold(F.zip_with(a, b, lambda x, y: x * y))

    def norm(v: Column) -> Column:
        return F.sqrt(_fold(F.transform(v, lambda x: x * x)))

    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)


def nearest_neighbours(df: DataFrame, key: str, vector: str, query, k: int = 5) -> DataFrame:
    """k rows nearest to one row's vector, without that row.

    One query vector is a single row; distances are a projection and the k best are taken
    per task before the final merge.
    """
    wanted = df.filter(F.col(key) == query).select(F.col(vector).alias("__q")).limit(1)
    scored = df.filter(F.col(key) != query).crossJoin(F.broadcast(wanted)).select(
        key, euclidean(vector, "__q").alias("distance"))
    return scored.orderBy("distance", key).limit(k)


def similarity_to(df: DataFrame, key: str, vector: str, query) -> DataFrame:
    wanted = df.filter(F.col(key) == query).select(F.col(vector).alias("__q")).limit(1)
    return df.crossJoin(F.broadcast(wanted)).select(key, cosine(vector, "__q").alias("similarity"))


def subsample(df: DataFrame, fraction: float, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """min(fraction * n, max_rows) rows without replacement; no row limit if ``max_rows`` is None.

    Every row draws a number once (kept by a checkpoint). Draws are counted in equal cells;
    cells below the wanted rank are taken whole and only the one that holds it is ordered.
    """
    total = df.count()
    wanted = int(total * fraction) if max_rows is None else min(int(total * fraction), max_rows)
    if wanted >= total:
        return df
    drawn = materialize(df.withColumn("__u", F.rand(seed))).withColumn("__cell", F.floor(F.col("__u") * DRAW_CELLS))
    left, last = wanted, 0
    for row in drawn.groupBy("__cell").count().orderBy("__cell").collect():
        last = row["__cell"]
        if row["count"] > left:
            break
        left -= row["count"]
    edge = drawn.filter(F.col("__cell") == last).orderBy("__u").limit(left)
    return drawn.filter(F.col("__cell") < last).unionByName(edge).drop("__u", "__cell")


def clipped_curve(df: DataFrame, predicted: str, floor: float = 1e-10) -> DataFrame:
    return df.withColumn(predicted, F.greatest(F.col(predicted), F.lit(floor))).orderBy("Energy")


