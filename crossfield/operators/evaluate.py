"""Metrics of predictions, validation against references, and physics penalties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions.scalars import finite
from crossfield.plans.ordering import with_previous
from crossfield.plans.quantiles import PERCENTILE_ROWS, table_percentiles
from crossfield.plans.scale import TASK_ROWS, attach, materialize


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------- metrics
def errors(truth: Column, predicted: Column, suffix: str = "") -> list[Column]:
    """MSE, MAE and R2 from sums, so that one aggregation with map-side combine does."""
    error = predicted - truth
    sse = F.sum(error * error)
    sst = F.var_pop(truth) * F.count(truth)
    return [
        F.avg(error * error).alias(f"mse{suffix}"), F.avg(F.abs(error)).alias(f"mae{suffix}"),
        F.when(sst > 0, 1.0 - sse / sst).alias(f"r2{suffix}"),
    ]


def regression_metrics(df: DataFrame, truth: str, predicted: str, log_space: bool = False) -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    if log_space:
        t, p = F.log10(t + 1e-10), F.log10(p + 1e-10)
    return df.agg(*errors(t, p))


def holdout_metrics(
    df: DataFrame, truth: str, predicted: str, truth_log: str, predicted_log: str, limit: int = PERCENTILE_ROWS
) -> DataFrame:
    """Metrics in log and linear space over finite rows; NULL with fewer than two rows."""
    valid = df.filter(finite(truth) & finite(predicted) & finite(truth_log) & finite(predicted_log))
    sums = materialize(valid.agg(
        F.count(F.lit(1)).alias("holdout_n"),
        *errors(F.col(truth_log), F.col(predicted_log), "_log"), *errors(F.col(truth), F.col(predicted), "_barns")))
    away = valid.select(F.abs(F.col(predicted) - F.col(truth)).alias("away"))
    median = table_percentiles(away, "away", {"medae_barns": 0.5}, limit, rows=sums.first()["holdout_n"])
    out = sums.join(F.broadcast(median), how="left")
    enough = F.col("holdout_n") > 1
    return out.select("holdout_n", *[
        F.when(enough, F.col(c)).alias(f"holdout_{c}") for c in out.columns if c != "holdout_n"])


def require_features(df: DataFrame, features: Sequence[str]) -> None:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"feature columns missing: {missing}")


def generalisation_gap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Relative MSE gap in percent, R2 difference and a verdict, from two metric rows."""
    both = train.select(F.col("mse").alias("a"), F.col("r2").alias("ra")).crossJoin(
        test.select(F.col("mse").alias("b"), F.col("r2").alias("rb")))
    gap = F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.abs("a") * 100.0)
    verdict = F.when(F.col("gap_pct") > 50, "overfitting").when(F.col("gap_pct") < 2, "underfitting").otherwise("normal")
    return both.select(gap.alias("gap_pct"), (F.col("rb") - F.col("ra")).alias("r2_gap")).withColumn("verdict", verdict)


# ---------------------------------------------------------------- references
def per_key_mse(df: DataFrame, reference: DataFrame, keys: Sequence[str], predicted: str, truth: str) -> DataFrame:
    """MSE per key present on both sides (``reference`` has one value per key)."""
    both = attach(df, reference.select(*keys, truth), keys, "inner")
    error = F.col(predicted) - F.col(truth)
    return both.groupBy(*keys).agg(F.avg(error * error).alias("mse"))


def mean_key_mse(df: DataFrame, reference: DataFrame, keys: Sequence[str], predicted: str, truth: str) -> DataFrame:
    return per_key_mse(df, reference, keys, predicted, truth).agg(F.avg("mse").alias("geometric_mse"))


def benchmark_table(spark) -> DataFrame:
    return spark.createDataFrame(K.CRITICALITY_BENCHMARKS, "benchmark string, k_reference double, k_sigma double")


def benchmark_validation(
    predictions: DataFrame, benchmarks: DataFrame, k: str = "k_predicted", sigma: str = "sigma_predicted"
) -> DataFrame:
    """Error, pcm, combined sigma and the 300 pcm criterion per prediction."""
    rows = predictions.join(benchmarks, "benchmark")
    error = F.col(k) - F.col("k_reference")
    rows = rows.withColumns({
        "error": error, "error_pcm": error * 1e5 / F.col("k_reference"),
        "uncertainty": F.sqrt(F.col("k_sigma") * F.col("k_sigma") + F.col(sigma) * F.col(sigma)),
    })
    significance = F.when(F.col("uncertainty") > 0, F.abs("error") / F.col("uncertainty")).when(
        F.col("error") != 0, F.lit(float("inf"))).otherwise(0.0)
    return rows.withColumns({"sigma": significance, "passed": F.abs("error_pcm") < 300})


def reactivity_error(k: Column | str, reference: Column | str) -> Column:
    """Reactivity difference in pcm."""
    k, r = _c(k), _c(reference)
    return ((k - 1.0) / k - (r - 1.0) / r) * 1e5


def reactivity_status(error: Column | str) -> Column:
    return F.when(F.abs(_c(error)) < 100, "PASS").otherwise("FAIL")


# --------------------------------------------------------------- sensitivity
def sensitivity_table(spark, reactor: str = "PWR") -> DataFrame:
    rows = K.SENSITIVITIES.get(reactor, K.SENSITIVITIES["PWR"])
    return spark.createDataFrame(rows, "Z int, A int, MT int, sensitivity double")


def add_sensitivity_weights(df: DataFrame, sensitivities: DataFrame, normalize: bool = True) -> DataFrame:
    """``weight``: |S| of the row's reaction, 0 when unlisted, over the largest present."""
    keys = ["Z", "A", "MT"]
    weighted = attach(df, sensitivities.select(*keys, F.abs("sensitivity").alias("weight")), keys)
    weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if not normalize:
        return weighted
    top = weighted.agg(F.max("weight").alias("__top"))
    scaled = F.when(F.col("__top") > 0, F.col("weight") / F.col("__top")).otherwise(F.col("weight"))
    return weighted.crossJoin(F.broadcast(top)).withColumn("weight", scaled).drop("__top")


def top_sensitivities(sensitivities: DataFrame, n: int = 10) -> DataFrame:
    return sensitivities.orderBy(F.abs("sensitivity").desc(), "Z", "A", "MT").limit(n).withColumn(
        "impact", impact_band("sensitivity"))


def impact_band(sensitivity: Column | str) -> Column:
    size = F.abs(_c(sensitivity))
    (first, limit), *rest = K.IMPACT_BANDS
    expr = F.when(size > limit, first)
    for name, limit in rest:
        expr = expr.when(size > limit, name)
    return expr.otherwise("NEGLIGIBLE")


def propagated_uncertainty(uncertainties: DataFrame, sensitivities: DataFrame, percent: str = "uncertainty_pct") -> DataFrame:
    """sqrt(sum((S u / 100)^2)) * 100 over the listed reactions."""
    rows = attach(uncertainties, sensitivities, ["Z", "A", "MT"])
    part = F.coalesce("sensitivity", F.lit(0.0)) * F.col(percent) / 100.0
    return rows.agg((F.sqrt(F.coalesce(F.sum(part * part), F.lit(0.0))) * 100.0).alias("k_uncertainty_pct"))


# ------------------------------------------------------------------- losses
def squared_loss(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    error = F.col(predicted) - F.col(truth)
    return df.agg(F.avg(error * error).alias("loss"))


def chi_squared(df: DataFrame, truth: str, predicted: str, sigma: str, floor: float = 1e-12) -> DataFrame:
    """Mean squared error over variance; plain MSE when any sigma is missing."""
    error = F.col(predicted) - F.col(truth)
    square = error * error
    variance = F.greatest(F.col(sigma) * F.col(sigma), F.lit(floor))
    complete = F.bool_and(finite(sigma))
    return df.agg(F.when(complete, F.avg(square / variance)).otherwise(F.avg(square)).alias("loss"))


def smoothness(
    df: DataFrame, keys: Sequence[str], x: str, y: str, min_step: float = 1e-12, limit: int = TASK_ROWS
) -> DataFrame:
    """Mean |dy/dx| along x per group."""
    steps = with_previous(df, keys, [x, y], [], limit).filter("prev1 IS NOT NULL")
    slope = (F.col(y) - F.col("prev1")[y]) / F.greatest(F.col(x) - F.col("prev1")[x], F.lit(min_step))
    return steps.groupBy(*keys).agg(F.avg(F.abs(slope)).alias("smoothness"))


def derivative_excess(
    df: DataFrame, keys: Sequence[str], x: str, y: str, bound: float = 100.0, limit: int = TASK_ROWS
) -> DataFrame:
    """Mean of max(0, |dy/dx| - bound) per group."""
    steps = with_previous(df, keys, [x, y], [], limit).filter("prev1 IS NOT NULL")
    slope = (F.col(y) - F.col("prev1")[y]) / (F.col(x) - F.col("prev1")[x] + 1e-10)
    return steps.groupBy(*keys).agg(F.avg(F.greatest(F.abs(slope) - bound, F.lit(0.0))).alias("excess"))


def resonance_penalties(
    df: DataFrame, keys: Sequence[str], x: str, y: str, thermal_below: float = 0.0,
    rise_above: float = 1.0, min_step: float = 1e-12, limit: int = TASK_ROWS,
) -> DataFrame:
    """1/v slope, falling slope above threshold, and curvature, in log-log space per group."""
    rows = with_previous(df, keys, [x, y], [], limit).filter("prev1 IS NOT NULL")

    def slope(x1: Column, y1: Column, x0: Column, y0: Column) -> Column:
        return (y1 - y0) / F.greatest(x1 - x0, F.lit(min_step))

    p1, p2 = F.col("prev1"), F.col("prev2")
    rows = rows.select(
        *keys, slope(F.col(x), F.col(y), p1[x], p1[y]).alias("__s1"), ((F.col(x) + p1[x]) * 0.5).alias("__m1"),
        slope(p1[x], p1[y], p2[x], p2[y]).alias("__s0"), ((p1[x] + p2[x]) * 0.5).alias("__m0"))
    s, m = F.col("__s1"), F.col("__m1")
    falling = F.greatest(-s, F.lit(0.0))
    bend = F.abs((s - F.col("__s0")) / F.greatest(m - F.col("__m0"), F.lit(min_step)))
    return rows.groupBy(*keys).agg(
        F.avg(F.when(m < thermal_below, (s + 0.5) * (s + 0.5))).alias("slope_penalty"),
        F.avg(F.when(m > rise_above, falling * falling)).alias("rise_penalty"),
        F.avg(F.when(F.col("__s0").isNotNull(), bend)).alias("curvature_penalty"))


def sensitivity_weighted_loss(
    df: DataFrame, truth: str, predicted: str, weight: str, kind: str = "mse", log_space: bool = True
) -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    if log_space:
        t, p = F.log10(t + 1e-10), F.log10(p + 1e-10)
    error = p - t
    size = F.abs(error)
    losses = {
        "mse": error * error, "mae": size,
        "huber": F.when(size < 1.0, 0.5 * error * error).otherwise(size - 0.5),
    }
    if kind not in losses:
        raise ValueError(f"kind must be one of {sorted(losses)}")
    # The largest weight is a constant of the mean, so one pass gives both.
    return df.agg((F.avg(losses[kind] * F.col(weight)) / (F.max(weight) + 1e-10)).alias("loss"))


def unitarity_excess(df: DataFrame, keys: Sequence[str], value: str, total_mt: int = 1) -> DataFrame:
    """Mean positive excess of the partial sums over the total, per point of ``keys``."""
    total = F.sum(F.when(F.col("MT") == total_mt, F.col(value)))
    partial = F.sum(F.when(F.col("MT") != total_mt, F.col(value)))
    points = df.groupBy(*keys).agg(total.alias("t"), F.coalesce(partial, F.lit(0.0)).alias("p"))
    return points.filter("t IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(F.greatest(F.col("p") - F.col("t"), F.lit(0.0))).alias("excess"))


def below_threshold(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean value counted only below each reaction's threshold energy."""
    rows = attach(df, thresholds.select(*keys, "threshold"), keys, "inner")
    return rows.agg(F.avg(F.when(F.col("Energy") < F.col("threshold"), F.col(value)).otherwise(0.0)).alias("violation"))


def negative_penalty(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(F.greatest(-F.col(value), F.lit(0.0))).alias("penalty"))
