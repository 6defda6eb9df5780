"""Scoring of groups too large for one task: the same definition, cut into tiles.

* trend - the cubic needs only moments, summed with map-side combine; a round of
  reweighting is two exact percentiles and one more sum;
* local sigma - rows are ranked along (x, residual), and each row's window gets its two end
  ranks. Medians and deviations come from ``plans.windows``, which counts whole tiles and
  reads only the edges of a window and the rows near its median; the running median over
  neighbouring ranks works the same way. A task's memory follows the tile, not the window.

Nothing is interpolated, sampled or dropped: a group above the limit gets the numbers that
one task would give, up to rounding in sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfield.operators import group_fit as G
from crossfield.operators.outliers import OutlierConfig, add_fit_weights, flag_experiments, flag_points, group_keys, prepare
from crossfield.plans.ordering import with_tiles
from crossfield.plans.quantiles import PERCENTILE_ROWS, group_percentiles
from crossfield.plans.scale import GroupSizes, attach, stored
from crossfield.plans.windows import window_medians

POWERS = 2 * G.DEGREE + 1
# Most rows of a tile of a group that no task scores at once.
TILE_ROWS = 200_000
ROUNDS = 5


def _points(rows: DataFrame, keys: list[str], config: OutlierConfig) -> tuple[DataFrame, DataFrame]:
    """Values averaged per energy (x, y, weight, rows), and the range and sizes of each group."""
    weighted = add_fit_weights(rows, keys) if _weightable(rows, config) else rows.withColumn(
        "fit_weight", F.lit(None).cast("double"))
    usable = F.col("log_E").isNotNull() & F.col("log_sigma").isNotNull()
    unique = stored(weighted.filter(usable).groupBy(*keys, F.col("log_E").alias("x")).agg(
        F.avg("log_sigma").alias("y"), F.avg(F.coalesce("fit_weight", F.lit(1.0))).alias("w"),
        F.count(F.lit(1)).alias("m")))
    span = stored(unique.groupBy(*keys).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("y").alias("mean_y"),
        F.count(F.lit(1)).alias("n_x"), F.sum("m").alias("n_rows")))
    return unique, span


def trend_criterion(df: DataFrame, config: OutlierConfig | None = None) -> DataFrame:
    """Whether the cubic satisfies the smoothing criterion, per group.

    ``criterion`` is the sum of squared weighted residuals of the first fit (weights scaled
    to mean 1), ``allowed`` the number of energies times the variance of the values. Where
    it is exceeded (``cubic_enough`` false), a smoother that adds knots until the criterion
    holds would bend more than the cubic does.
    """
    config = config or OutlierConfig()
    rows, keys = prepare(df, config), group_keys(df)
    unique, span = _points(rows, keys, config)
    points = attach(unique, span, keys).withColumn("t", scaled("x"))
    fitted = attach(points, _coefficients(_moments(points, keys, F.col("w")), keys), keys)
    residual = F.col("w") * (F.col("y") - polynomial(F.col("t"), F.col("coef")))
    sums = fitted.groupBy(*keys, "n_x", "n_rows").agg(
        F.sum(residual * residual).alias("q"), F.sum("w").alias("sw"), F.var_pop("y").alias("v"))
    criterion = F.col("q") * F.col("n_x") * F.col("n_x") / (F.col("sw") * F.col("sw"))
    allowed = F.col("n_x") * F.greatest(F.col("v"), F.lit(1e-6))
    return sums.select(*keys, "n_x", "n_rows", criterion.alias("criterion"), allowed.alias("allowed"),
                       (criterion <= allowed).alias("cubic_enough"))


def score_hot(rows: DataFrame, keys: list[str], config: OutlierConfig) -> DataFrame:
    unique, span = _points(rows, keys, config)
    counts = stored(span.select(*keys, F.col("n_x").alias("group_rows")))
    sizes = GroupSizes(counts, keys, PERCENTILE_ROWS, counts.agg(F.max("group_rows")).first()[0] or 0)
    trend = robust_trend(stored(attach(unique, span, keys)), keys, sizes)
    facts = stored(attach(span, trend, keys))
    centred = attach(rows, facts, keys).withColumn("gp_mean", polynomial(scaled("log_E"), F.col("coef")))
    sigma = local_sigma(centred.withColumn("r", F.col("log_sigma") - F.col("gp_mean")), keys, config)
    placed = attach(centred, sigma, [*keys, "log_E"])
    scored = flag_points(placed, "gp_mean", "gp_std", point_z=config.point_z)
    kept = scored.select(*rows.columns, "gp_mean", "gp_std", "z_score", "point_outlier")
    return flag_experiments(
        kept, keys, z_limit=config.experiment_z, share=config.experiment_share, min_group=config.min_group)


def _weightable(rows: DataFrame, config: OutlierConfig) -> bool:
    return config.use_uncertainties and "Uncertainty" in rows.columns


def scaled(x: str) -> Column:
    """x on [-1, 1] over its group."""
    width = F.col("hi") - F.col("lo")
    return F.when(width > 0, (2.0 * F.col(x) - F.col("lo") - F.col("hi")) / width).otherwise(0.0)


def polynomial(t: Column, coef: Column) -> Column:
    value = coef[G.DEGREE]
    for power in range(G.DEGREE - 1, -1, -1):
        value = value * t + coef[power]
    return value


def _moments(df: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Sums of w^2 t^p and w^2 t^p y per group."""
    square, t = weight * weight, F.col("t")

    def power(p: int) -> Column:
        out = square
        for _ in range(p):
            out = out * t
        return out

    return df.groupBy(*keys, "n_x", "mean_y").agg(
        *[F.sum(power(p)).alias(f"m{p}") for p in range(POWERS)],
        *[F.sum(power(p) * F.col("y")).alias(f"b{p}") for p in range(G.DEGREE + 1)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(moments: pd.Series) -> pd.Series:
    """Coefficients from the moments of one group per row."""
    def solve(m):
        m = np.asarray(m)
        size = G.DEGREE + 1
        matrix = m[np.add.outer(np.arange(size), np.arange(size))]
        return np.linalg.lstsq(matrix, m[POWERS:], rcond=None)[0].tolist()
    return moments.map(solve)


def _coefficients(moments: DataFrame, keys: list[str]) -> DataFrame:
    packed = F.array(*[f"m{p}" for p in range(POWERS)], *[f"b{p}" for p in range(G.DEGREE + 1)])
    constant = F.array(F.col("mean_y"), *[F.lit(0.0)] * G.DEGREE)
    coef = F.when(F.col("n_x") > G.DEGREE, _solve(packed)).otherwise(constant)
    return stored(moments.select(*keys, coef.alias("coef")))


def robust_trend(unique: DataFrame, keys: list[str], sizes: GroupSizes, rounds: int = ROUNDS) -> DataFrame:
    """Cubic per group on points averaged per x; a group stops once it has settled."""
    points = unique.withColumn("t", scaled("x"))
    current = _coefficients(_moments(points, keys, F.col("w")), keys).withColumn("settled", F.lit(False))
    for _ in range(rounds):
        active = attach(points, current.filter("NOT settled"), keys, "inner")
        residual = active.withColumn("r", F.col("y") - polynomial(F.col("t"), F.col("coef")))
        middle = stored(group_percentiles(residual, keys, "r", {"med": 0.5}, sizes.limit, sizes=sizes))
        away = attach(residual, middle, keys).withColumn("distance", F.abs(F.col("r") - F.col("med")))
        mad = stored(group_percentiles(away, keys, "distance", {"mad": 0.5}, sizes.limit, sizes=sizes))
        judged = attach(residual, mad.filter("mad >= 1e-12"), keys, "inner")
        distance = F.abs("r") / (F.col("mad") * G.MAD_TO_SIGMA)
        factor = F.when(distance <= 3.0, 1.0).otherwise(3.0 / distance)
        fresh = _coefficients(_moments(judged, keys, F.col("w") * factor), keys)
        moved = attach(judged, fresh.withColumnRenamed("coef", "next"), keys, "inner").groupBy(*keys).agg(
            F.first("next").alias("next"),
            F.max(F.abs(polynomial(F.col("t"), F.col("next")) - polynomial(F.col("t"), F.col("coef")))).alias("step"))
        update = moved.select(*keys, "next", (F.col("step") < 1e-4).alias("near"))
        current = stored(attach(current, update, keys).select(
            *keys, F.coalesce("next", "coef").alias("coef"),
            (F.col("settled") | F.coalesce("near", F.lit(True))).alias("settled")))
        if current.filter("NOT settled").isEmpty():
            break
    return current.select(*keys, "coef")


def local_sigma(centred: DataFrame, keys: list[str], config: OutlierConfig) -> DataFrame:
    """(keys, log_E, gp_std): the floored and smoothed rolling MAD, one value per distinct energy."""
    limit = max(min(config.score_rows, TILE_ROWS), 2 * config.window_points)
    half = F.greatest((F.col("hi") - F.col("lo")) * config.window_fraction, F.lit(0.1))
    points = centred.filter("log_E IS NOT NULL AND r IS NOT NULL").select(
        *keys, half.alias("half"), "n_rows", F.col("log_E").alias("x"), "r")
    ranked = stored(with_tiles(points, keys, ["x", "r"], limit, rank_as="rank").drop("__tile"))
    placed = stored(_window_ends(ranked, keys, limit))
    few = F.col("e") - F.col("s") < config.window_points
    windows = placed.select(*keys, "rank", F.col("r").alias("v"), *[F.when(~few, F.col(c)).alias(c) for c in ("s", "e")])
    mads = window_medians(windows, keys, limit, spread=True).select(*keys, "rank", "mad")
    mads = mads.unionByName(_sparse_mads(placed, placed.filter(few), keys, config.window_points))
    mad = F.greatest(F.col("mad") * G.MAD_TO_SIGMA, F.lit(config.sigma_floor))
    at = attach(ranked.select(*keys, "rank", "x", "n_rows"), mads.select(*keys, "rank", mad.alias("v")), [*keys, "rank"])
    smooth = _running_medians(stored(at), keys, limit)
    return smooth.groupBy(*keys, F.col("x").alias("log_E")).agg(
        F.greatest(F.avg(F.greatest("s", F.lit(config.sigma_floor))), F.lit(config.sigma_floor)).alias("gp_std"))


def _window_ends(ranked: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Add ``s`` and ``e``: the ranks of x - half (first row at or after) and x + half (first row beyond).

    Each end is sorted among the rows; its place there less the ends before it (as many as its
    own row's rank) is the number of rows before it.
    """
    def ends(name: str, at: Column, first: bool) -> DataFrame:
        rows = ranked.select(*keys, F.col("x").alias("t"), F.lit(1).alias("kind"), "rank")
        probes = ranked.select(*keys, at.alias("t"), F.lit(0 if first else 2).alias("kind"), "rank")
        both = with_tiles(rows.unionByName(probes), keys, ["t", "kind", "rank"], limit, rank_as="place")
        return both.filter("kind <> 1").select(*keys, "rank", (F.col("place") - F.col("rank")).alias(name))

    x, half = F.col("x"), F.col("half")
    return attach(attach(ranked, ends("s", x - half, True), [*keys, "rank"]), ends("e", x + half, False), [*keys, "rank"])


def _sparse_mads(placed: DataFrame, sparse: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Windows with fewer than ``points`` rows take the nearest ones (ties by x, then r).

    There are few: a window spans a fifth of the range, so a group has at most ten times
    ``points`` of them. The nearest rows lie within ``points`` ranks; of a tie in x on the left,
    the first rows count, which may stand further away.
    """
    around = sparse.select(*keys, F.col("rank").alias("own"), F.col("x").alias("at"), F.explode(
        F.sequence(F.greatest(F.col("rank") - points + 1, F.lit(0)), F.least(F.col("rank") + points - 1, F.col("n_rows") - 1))).alias("rank"))
    edge = around.groupBy(*keys, "own", "at").agg(F.min("rank").alias("rank"))
    values = placed.select(*keys, "rank", "x", "r")
    ties = stored(attach(stored(edge), values.select(*keys, "rank", "x"), [*keys, "rank"]).select(*keys, "own", "at", "x"))
    starts = attach(values, ties.select(*keys, "x").distinct().withColumn("__asked", F.lit(True)), [*keys, "x"]).filter(
        "__asked").groupBy(*keys, "x").agg(F.min("rank").alias("first"))
    more = attach(ties, starts, [*keys, "x"]).select(
        *keys, "own", "at", F.explode(F.sequence(F.col("first"), F.col("first") + points - 1)).alias("rank"))
    near = attach(around.unionByName(more).distinct(), values, [*keys, "rank"], "inner").groupBy(*keys, "own", "at").agg(
        F.collect_list(F.struct("x", "r")).alias("near"))                     # at most 3 * points rows each
    listed = F.array_sort(F.transform("near", lambda p: F.struct(F.abs(p["x"] - F.col("at")).alias("d"), p["x"].alias("x"), p["r"].alias("r"))))
    value = F.array_sort(F.transform(F.slice(listed, 1, points), lambda p: p["r"]))
    mid, size = F.col("l"), F.size("l")

    def median(a: Column) -> Column:
        return (a[((size - 1) / 2).cast("int")] + a[(size / 2).cast("int")]) / 2.0

    centre = near.select(*keys, "own", value.alias("l")).withColumn("centre", median(mid))
    away = F.array_sort(F.transform("l", lambda v: F.abs(v - F.col("centre"))))
    return centre.select(*keys, F.col("own").alias("rank"), median(away).alias("mad"))


def _running_medians(mads: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, x, s): the running median over a twentieth of the ranks around each row, end values repeated."""
    size = F.greatest(F.lit(5), F.floor(F.col("n_rows") / 20))
    half = F.floor((size + (size % 2 == 0).cast("int")) / 2)
    rows = mads.withColumn("half", half)
    # Copies of the first and the last row stand before and behind; ranks move up by ``half``.
    copies = F.sequence(F.lit(0).cast("long"), F.col("half") - 1)
    none = F.lit(None).cast("long")
    padded = rows.select(*keys, (F.col("rank") + F.col("half")).alias("rank"), "v", F.col("rank").alias("s"),
                         (F.col("rank") + 2 * F.col("half") + 1).alias("e"))
    for end, first in ((F.col("rank") == 0, F.lit(0).cast("long")), (F.col("rank") == F.col("n_rows") - 1, F.col("n_rows") + F.col("half"))):
        padded = padded.unionByName(rows.filter(end).select(
            *keys, "v", first.alias("first"), F.explode(copies).alias("i")).select(
            *keys, (F.col("first") + F.col("i")).alias("rank"), "v", none.alias("s"), none.alias("e")))
    found = window_medians(padded, keys, limit).withColumnRenamed("rank", "shifted").withColumnRenamed("median", "s")
    own = rows.select(*keys, "x", (F.col("rank") + F.col("half")).alias("shifted"))
    return attach(own, found, [*keys, "shifted"]).select(*keys, "x", "s")
