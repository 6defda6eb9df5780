"""Outlier scores of points and experiments around a robust local trend.

Rows are grouped by (Z, A, MT, Projectile). Groups that fit a task are scored in one
pass over Arrow batches after a single shuffle on the keys. Hot groups go through
``outliers_hot``, which works on aggregates and never gathers a group.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crossfield.functions.scalars import finite
from crossfield.operators import group_fit as G
from crossfield.operators.profile import with_logs
from crossfield.plans.quantiles import PERCENTILE_ROWS, group_percentiles
from crossfield.plans.scale import GroupSizes, attach, fits, group_sizes, materialize

# Rows of one group a task scores at once: some ten seconds of work, and 200 MB with all columns.
SCORE_ROWS = 800_000
# Rows of a table up to which whole rows are shuffled for windows instead of read again for counts.
SHUFFLED_ROWS = 2_000_000
ENTRY_NAMES = ["Entry", "entry", "ENTRY", "ExforEntry", "exfor_entry"]
SCORE_FIELDS = [
    T.StructField(name, T.DoubleType() if i < 3 else T.BooleanType()) for i, name in enumerate(G.SCORE_NAMES)
]


@dataclass
class OutlierConfig:
    point_z: float = 3.0
    min_group: int = 10
    entry_column: str = "Entry"
    window_fraction: float = 0.1
    window_points: int = 15
    sigma_floor: float = 0.02
    use_uncertainties: bool = True
    experiment_z: float = 3.0
    experiment_share: float = 0.30
    score_rows: int = SCORE_ROWS
    # Keep rows without a projectile unscored when other rows have one.
    skip_null_projectile: bool = False


def group_keys(df: DataFrame) -> list[str]:
    keys = ["Z", "A", "MT"]
    if "Projectile" in df.columns and not df.filter(F.col("Projectile").isNotNull()).isEmpty():
        keys.append("Projectile")
    return keys


def prepare(df: DataFrame, config: OutlierConfig) -> DataFrame:
    """Log columns and the experiment id: the first entry column found, else 'unknown'.

    Rows without an id form one experiment of that name.
    """
    missing = [c for c in ("Z", "A", "MT", "Energy", "CrossSection") if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    entry = next((c for c in [config.entry_column, *ENTRY_NAMES] if c in df.columns), None)
    unknown = F.lit("unknown")
    experiment = F.coalesce(F.col(entry).cast("string"), unknown) if entry else unknown
    return with_logs(df).withColumn("experiment_id", experiment)


def score(df: DataFrame, config: OutlierConfig | None = None) -> DataFrame:
    """All rows with trend, local sigma, z-score and the two outlier flags."""
    from crossfield.operators.outliers_hot import score_hot

    config = config or OutlierConfig()
    rows, keys = prepare(df, config), group_keys(df)
    unscored = None
    if config.skip_null_projectile and "Projectile" in keys:
        unscored = rows.filter("Projectile IS NULL")
        rows = rows.filter("Projectile IS NOT NULL")
    sizes = group_sizes(rows, keys, config.score_rows)
    if sizes.bounded:
        scored = score_in_tasks(rows, keys, config)
    else:
        ordinary, hot = sizes.split(rows)
        scored = score_in_tasks(ordinary, keys, config).unionByName(score_hot(hot, keys, config))
    if unscored is not None:
        scored = scored.unionByName(unscored.withColumns({
            f.name: F.lit(False) if f.dataType == T.BooleanType() else F.lit(None).cast("double")
            for f in SCORE_FIELDS}))
    null = F.lit(None).cast("double")
    return scored.withColumns({"calibration_metric": null, "outlier_probability": null})


def score_in_tasks(rows: DataFrame, keys: list[str], config: OutlierConfig) -> DataFrame:
    """Groups of bounded size, one call per group; other columns pass through as Arrow."""
    settings = asdict(config)
    schema = T.StructType([*rows.schema.fields, *SCORE_FIELDS])

    def run(table: pa.Table) -> pa.Table:
        return G.score_group(table, settings)

    return rows.groupBy(*keys).applyInArrow(run, schema)


# --------------------------------------------------- pieces as plain plans
def score_by_median(
    df: DataFrame, keys: list[str], y: str = "log_sigma", point_z: float = 3.0, limit: int = PERCENTILE_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Median and MAD scores of every group from exact percentiles.

    Ordinary groups are shuffled once on the keys and take both percentiles from windows. Groups
    above ``limit`` are not gathered: their percentiles are narrowed and joined back.
    """
    sizes = sizes or group_sizes(df, keys, limit)
    if sizes.bounded:
        return _median_scores(df, keys, y, point_z)
    ordinary, hot = sizes.split(df)
    return _median_scores(ordinary, keys, y, point_z).unionByName(_hot_median_scores(hot, keys, y, point_z, limit))


def _scored_from_median(away: DataFrame, mad: Column, point_z: float) -> DataFrame:
    scale = mad * G.MAD_TO_SIGMA
    out = away.withColumn("gp_std", F.when(scale < 1e-10, 1e-6).otherwise(scale)).drop("__mad")
    return out.withColumn("z_score", F.col("__away") / F.col("gp_std")).withColumn(
        "point_outlier", F.col("z_score") > point_z).drop("__away")


def _median_scores(df: DataFrame, keys: list[str], y: str, point_z: float) -> DataFrame:
    group = Window.partitionBy(*keys)
    centred = df.withColumn("gp_mean", F.percentile(F.col(y).cast("double"), F.lit(0.5)).over(group))
    away = centred.withColumn("__away", F.abs(F.col(y) - F.col("gp_mean")))
    return _scored_from_median(away, F.percentile("__away", F.lit(0.5)).over(group), point_z)


def _hot_median_scores(df: DataFrame, keys: list[str], y: str, point_z: float, limit: int) -> DataFrame:
    centred = attach(df, group_percentiles(df, keys, y, {"gp_mean": 0.5}, limit), keys)
    away = centred.withColumn("__away", F.abs(F.col(y) - F.col("gp_mean")))
    spread = group_percentiles(away, keys, "__away", {"__mad": 0.5}, limit)
    return _scored_from_median(attach(away, spread, keys), F.col("__mad"), point_z)


def score_experiments(
    df: DataFrame, keys: list[str], entry: str = "experiment_id", y: str = "log_sigma", config: OutlierConfig | None = None,
    limit: int = PERCENTILE_ROWS, shuffled_rows: int = SHUFFLED_ROWS,
) -> DataFrame:
    """``score_by_median`` and ``flag_experiments`` together.

    In a small table, ordinary groups need a count and one shuffle: a window by keys and experiment
    finds its rows where those by keys alone have put them. Windows sort whole rows again and
    again, which spills in a large one; where its groups are few enough to be broadcast,
    percentiles and counts are aggregated and only they are moved.
    """
    config = config or OutlierConfig()
    sizes = group_sizes(df, keys, limit)
    rules = config.experiment_z, config.experiment_share, config.min_group

    def in_windows(rows: DataFrame) -> DataFrame:
        return _flagged_in_windows(_median_scores(rows, keys, y, config.point_z), keys, entry, *rules)

    rows = sizes.table.agg(F.sum("group_rows")).first()[0] or 0
    if rows > shuffled_rows and fits(sizes.table):
        return flag_experiments(_hot_median_scores(df, keys, y, config.point_z, limit), keys, entry, *rules)
    if sizes.bounded:
        return in_windows(df)
    ordinary, hot = sizes.split(df)
    scored = flag_experiments(_hot_median_scores(hot, keys, y, config.point_z, limit), keys, entry, *rules)
    return in_windows(ordinary).unionByName(scored)


def _flagged_in_windows(
    df: DataFrame, keys: list[str], entry: str, z_limit: float, share: float, min_group: int,
) -> DataFrame:
    group, experiment = Window.partitionBy(*keys), Window.partitionBy(*keys, entry)
    one = F.lit(1)
    bad = F.count_if(F.col("z_score") > z_limit).over(experiment) / F.count(one).over(experiment)
    # Rows without an id are an experiment too.
    known = F.count(entry).over(group)
    several = (F.min(entry).over(group) != F.max(entry).over(group)) | ((known > 0) & (known < F.count(one).over(group)))
    flag = (bad > share) & F.coalesce(several, F.lit(False)) & (F.count(one).over(group) >= min_group)
    return df.drop("experiment_outlier").withColumn("experiment_outlier", F.coalesce(flag, F.lit(False)))


def score_small_policy(
    df: DataFrame, keys: list[str], y: str = "log_sigma", size_as: str | None = None, limit: int = PERCENTILE_ROWS,
) -> DataFrame:
    """A lone point scores 0 with sigma 1; other groups take median and MAD.

    ``size_as`` keeps the number of rows of the group. Groups that fit a task are counted where the
    shuffle of their scores has put them.
    """
    counts = group_sizes(df, keys, limit)
    scored = score_by_median(df, keys, y, limit=limit, sizes=counts)
    if counts.bounded:
        scored = scored.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        scored = attach(scored, counts.table.withColumnRenamed("group_rows", "__size"), keys)
    lone = F.col("__size") == 1
    mean = F.when(lone, F.col(y)).otherwise(F.col("gp_mean"))
    sigma = F.when(lone, 1.0).otherwise(F.col("gp_std"))
    z = F.when(lone, 0.0).otherwise(F.abs(F.col(y) - F.col("gp_mean")) / F.greatest("gp_std", F.lit(1e-10)))
    out = scored.withColumns({"gp_mean": mean, "gp_std": sigma, "z_score": z}).drop("point_outlier")
    return out.withColumnRenamed("__size", size_as) if size_as else out.drop("__size")


def known_uncertainty() -> Column:
    return finite("Uncertainty") & (F.col("Uncertainty") > 0) & F.coalesce(F.col("CrossSection") > 0, F.lit(False))


def add_fit_weights(df: DataFrame, keys: list[str], limit: int = PERCENTILE_ROWS) -> DataFrame:
    """``fit_weight``: clipped inverse variance, NULL in groups with too few uncertainties."""
    relative = F.least(F.greatest(0.434 * F.col("Uncertainty") / F.col("CrossSection"), F.lit(0.005)), F.lit(0.5))
    raw = F.when(known_uncertainty(), 1.0 / (relative * relative)).otherwise(1.0)
    rows = df.withColumn("__w", raw)
    share = rows.groupBy(*keys).agg(F.avg(known_uncertainty().cast("double")).alias("__share"))
    middle = group_percentiles(rows, keys, "__w", {"__mid": 0.5}, limit)
    facts = attach(share, middle, keys)
    clipped = F.least(F.greatest(F.col("__w"), F.col("__mid") / 100), F.col("__mid") * 100)
    return attach(rows, facts, keys).withColumn(
        "fit_weight", F.when(F.col("__share") >= 0.10, clipped)).drop("__w", "__mid", "__share")


def flag_points(df: DataFrame, mean: str, sigma: str, y: str = "log_sigma", point_z: float = 3.0) -> DataFrame:
    z = F.abs(F.col(y) - F.col(mean)) / F.col(sigma)
    return df.withColumn("z_score", z).withColumn("point_outlier", F.coalesce(z > point_z, F.lit(False)))


def flag_experiments(
    df: DataFrame, keys: list[str], entry: str = "experiment_id", z_limit: float = 3.0,
    share: float = 0.30, min_group: int = 10,
) -> DataFrame:
    """Experiments with too many distant points, where a group has several experiments.

    Counts are combined per (group, experiment); only flagged pairs are joined back.
    """
    per = materialize(df.groupBy(*keys, entry).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("z_score") > z_limit).alias("__bad")))
    groups = per.groupBy(*keys).agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__experiments"))
    flagged = attach(per, groups, keys).filter(
        (F.col("__bad") / F.col("__n") > share) & (F.col("__experiments") > 1) & (F.col("__rows") >= min_group)
    ).select(*keys, entry, F.lit(True).alias("experiment_outlier"))
    return attach(df.drop("experiment_outlier"), flagged, [*keys, entry]).withColumn(
        "experiment_outlier", F.coalesce("experiment_outlier", F.lit(False)))


def log_space_uncertainty(df: DataFrame, keys: list[str]) -> DataFrame:
    """``log_uncertainty``: relative error, missing as the group's largest, in log10 units.

    Groups without any valid uncertainty stay NULL.
    """
    valid = known_uncertainty() & finite("CrossSection")
    rows = df.withColumn("__rel", F.when(valid, F.col("Uncertainty") / F.col("CrossSection")))
    largest = rows.groupBy(*keys).agg(F.max("__rel").alias("__max"))
    bounded = F.least(F.greatest(F.coalesce("__rel", "__max"), F.lit(0.01)), F.lit(1.0))
    return attach(rows, largest, keys).withColumn(
        "log_uncertainty", F.when(F.col("__max").isNotNull(), 0.434 * bounded)).drop("__rel", "__max")


def bands(df: DataFrame, levels: tuple[float, ...] = (1.0, 2.0), threshold: float = 3.0) -> DataFrame:
    """Trend plus and minus 1, 2 and t sigma, in log and in linear space."""
    out = {}
    for name, k in [*((f"{lv:g}", lv) for lv in levels), ("t", threshold)]:
        for sign, side in ((-1.0, "low"), (1.0, "high")):
            edge = F.col("gp_mean") + sign * k * F.col("gp_std")
            out[f"log_{side}_{name}"] = edge
            out[f"{side}_{name}"] = F.pow(F.lit(10.0), edge)
    return df.withColumns(out)


def probability_surface(scored: DataFrame, keys: list[str], grid: int = 200, pad: float = 1.0) -> DataFrame:
    """Normal density of log value on a grid over each group's range.

    Trend and sigma are interpolated between a grid line's two neighbouring points. The
    neighbours are the last point at or before it and the first at or after it, found by
    aggregating points per grid interval: no group is sorted.
    """
    points = scored.groupBy(*keys, "log_E").agg(
        F.min(F.struct("gp_mean", "gp_std")).alias("fit"), F.min("log_sigma").alias("s0"), F.max("log_sigma").alias("s1"))
    span = points.groupBy(*keys).agg(
        F.min("log_E").alias("lo"), F.max("log_E").alias("hi"), F.count(F.lit(1)).alias("n"),
        (F.min("s0") - pad).alias("smin"), (F.max("s1") + pad).alias("smax")).filter("n >= 2")
    step = (F.col("hi") - F.col("lo")) / (grid - 1)
    node = F.struct(F.col("log_E").alias("x"), F.col("fit.gp_mean").alias("m"), F.col("fit.gp_std").alias("s"))
    placed = attach(points, span, keys, "inner").withColumn("i", F.least(
        F.floor((F.col("log_E") - F.col("lo")) / step), F.lit(grid - 1)))
    per = placed.groupBy(*keys, "i").agg(F.min(node).alias("first"), F.max(node).alias("last"))
    lines = span.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))))
    lines = attach(lines, per, [*keys, "i"]).withColumn("x", F.col("lo") + F.col("i") * step)
    # ``grid`` rows per group: bounded, so an ordered window is safe here.
    along = Window.partitionBy(*keys).orderBy("i")
    lines = lines.select(
        "*",
        F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("left"),
        F.first("first", True).over(along.rowsBetween(0, Window.unboundedFollowing)).alias("right"))
    left, right = F.coalesce("left", "right"), F.coalesce("right", "left")
    part = F.when(right["x"] > left["x"], (F.col("x") - left["x"]) / (right["x"] - left["x"])).otherwise(0.0)
    lines = lines.select(
        *keys, "i", "x", "smin", "smax",
        (left["m"] + part * (right["m"] - left["m"])).alias("mean"),
        F.greatest(left["s"] + part * (right["s"] - left["s"]), F.lit(1e-10)).alias("sigma"))
    cells = lines.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    value = F.col("smin") + F.col("j") * (F.col("smax") - F.col("smin")) / (grid - 1)
    u = (value - F.col("mean")) / F.col("sigma")
    density = F.exp(-0.5 * u * u) / (F.col("sigma") * F.sqrt(2.0 * F.pi()))
    return cells.select(*keys, "i", "j", "x", value.alias("y"), "mean", "sigma", density.alias("density"))
