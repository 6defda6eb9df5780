"""Coverage, quality and outlier reports: one aggregation each wherever possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield import constants as K
from crossfield.functions import labels as L
from crossfield.functions.scalars import clipped_log10, finite
from crossfield.operators.select import remaining_mask
from crossfield.plans.quantiles import PERCENTILE_ROWS, group_percentiles, table_percentiles
from crossfield.plans.scale import TASK_ROWS, attach, group_sizes, materialize

NUCLIDE = ["Z", "A"]


def row_count() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def _distinct_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct keys in two combined steps, so the keys spread over tasks."""
    return df.select(*keys).distinct().agg(row_count().alias(name))


# ------------------------------------------------------------------ outliers
def outlier_summary(df: DataFrame, thresholds: Sequence[float] = tuple(K.OUTLIER_THRESHOLDS)) -> DataFrame:
    """Outliers, percent and retained rows per threshold, counted in one pass."""
    counted = df.agg(row_count().alias("total"), *[
        F.count_if(F.col("z_score") > t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("outliers"))
        for i, t in enumerate(thresholds)])
    return counted.select("total", F.inline(rows)).select(
        "threshold", "outliers", percent(F.col("outliers"), F.col("total")).alias("pct"),
        (F.col("total") - F.col("outliers")).alias("retained"))


def _per_experiment(df: DataFrame, entry: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and flagged rows per experiment: the small table distinct counts come from."""
    return df.groupBy(*keys, entry).agg(row_count().alias("__n"), F.count_if("experiment_outlier").alias("__bad"))


def experiment_summary(df: DataFrame, entry: str = "Entry") -> DataFrame:
    out = _per_experiment(df, entry).agg(
        F.count(entry).alias("n_experiments"),
        F.count(F.when(F.col("__bad") > 0, F.col(entry))).alias("n_discrepant"),
        F.coalesce(F.sum("__bad"), F.lit(0)).alias("n_points_in_discrepant"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("__total"))
    return out.select(
        "n_experiments", "n_discrepant",
        percent(F.col("n_discrepant"), F.col("n_experiments")).alias("pct_discrepant"),
        "n_points_in_discrepant",
        percent(F.col("n_points_in_discrepant"), F.col("__total")).alias("pct_points_affected"))


def outlier_rates(df: DataFrame, entry: str = "experiment_id") -> DataFrame:
    per = df.groupBy(entry).agg(
        row_count().alias("__n"), F.count_if("point_outlier").alias("__p"), F.count_if("experiment_outlier").alias("__bad"))
    out = per.agg(
        F.sum("__n").alias("n_total_points"), F.count(entry).alias("n_experiments"),
        F.sum("__p").alias("n_point_outliers"),
        F.count(F.when(F.col("__bad") > 0, F.col(entry))).alias("n_exp_outliers"))
    return out.select(
        "n_total_points", "n_experiments", "n_point_outliers",
        (F.col("n_point_outliers") / F.col("n_total_points")).alias("point_outlier_rate"),
        "n_exp_outliers", (F.col("n_exp_outliers") / F.col("n_experiments")).alias("exp_outlier_rate"))


def group_statistics(
    df: DataFrame, keys: Sequence[str], threshold: float = 3.0, entry: str = "Entry", **exclusions: bool
) -> DataFrame:
    """Inliers, outliers, rows left after the chosen exclusions, experiments per group.

    Experiments are first combined per (group, experiment), so that counting them needs
    no set of values in one task.
    """
    keys = list(keys)
    left = remaining_mask(threshold, **exclusions)
    per = df.groupBy(*keys, entry).agg(
        row_count().alias("__n"), F.count_if(F.col("z_score") > threshold).alias("__out"),
        F.count_if(left).alias("__left"), F.min("z_score").alias("__zmin"), F.max("z_score").alias("__zmax"),
        F.count_if("experiment_outlier").alias("__bad"))
    out = per.groupBy(*keys).agg(
        F.sum("__n").alias("total"), F.sum("__out").alias("n_outliers"), F.sum("__left").alias("n_remaining"),
        F.min("__zmin").alias("z_min"), F.max("__zmax").alias("z_max"),
        F.count(entry).alias("n_experiments"),
        F.count(F.when(F.col("__bad") > 0, F.col(entry))).alias("n_discrepant"),
        F.sum("__bad").alias("n_points_in_discrepant"))
    total = F.col("total")
    return out.withColumns({
        "n_inliers": total - F.col("n_outliers"),
        "pct_outliers": percent(F.col("n_outliers"), total),
        "pct_inliers": percent(total - F.col("n_outliers"), total),
        "pct_remaining": percent(F.col("n_remaining"), total),
    })


def group_state(df: DataFrame, keys: Sequence[str], mean: str = "gp_mean", sigma: str = "gp_std") -> DataFrame:
    """single / constant (one mean and one sigma throughout) / full, per group.

    Equal minimum and maximum is the same test as one distinct value, without the set.
    """
    out = df.groupBy(*keys).agg(
        row_count().alias("n"),
        ((F.min(mean) == F.max(mean)) & (F.min(sigma) == F.max(sigma))).alias("__same"))
    state = F.when(F.col("n") == 1, "single").when(F.col("__same"), "constant").otherwise("full")
    return out.withColumn("state", state).drop("__same")


# --------------------------------------------------------------- whole table
def dataset_statistics(df: DataFrame) -> DataFrame:
    """Rows, nuclides, reactions and value ranges from per-key partial results."""
    per = df.groupBy(*NUCLIDE, "MT").agg(
        row_count().alias("__n"), F.min("Energy").alias("__e0"), F.max("Energy").alias("__e1"),
        F.min("CrossSection").alias("__x0"), F.max("CrossSection").alias("__x1"))
    return per.agg(
        F.sum("__n").alias("n_points"), F.countDistinct(*NUCLIDE).alias("n_isotopes"),
        F.countDistinct("MT").alias("n_reactions"),
        F.min("__e0").alias("energy_min"), F.max("__e1").alias("energy_max"),
        F.min("__x0").alias("xs_min"), F.max("__x1").alias("xs_max"))


def has_uncertainty(column: str = "Uncertainty") -> Column:
    return F.coalesce(F.col(column) > 0, F.lit(False))


def ingest_summary(df: DataFrame) -> DataFrame:
    per = df.groupBy(*NUCLIDE, "MT").agg(
        row_count().alias("__n"), F.min("Energy").alias("__e0"), F.max("Energy").alias("__e1"),
        F.count("Uncertainty").alias("__u"), F.count("Energy_Uncertainty").alias("__eu"))
    out = per.agg(
        F.sum("__n").alias("n_points"), F.countDistinct(*NUCLIDE).alias("n_isotopes"),
        F.countDistinct("MT").alias("n_reactions"),
        F.min("__e0").alias("energy_min"), F.max("__e1").alias("energy_max"),
        F.sum("__u").alias("__u"), F.sum("__eu").alias("__eu"))
    return out.withColumns({
        "uncertainty_pct": percent(F.col("__u"), F.col("n_points")),
        "energy_uncertainty_pct": percent(F.col("__eu"), F.col("n_points")),
    }).drop("__u", "__eu")


def uncertainty_coverage(df: DataFrame, column: str = "Uncertainty") -> DataFrame:
    """Rows with an uncertainty, and its percentiles where present: two scans while they fit a task."""
    counts = materialize(df.agg(row_count().alias("total"), F.count_if(has_uncertainty(column)).alias("with_uncertainty")))
    known = counts.first()["with_uncertainty"]
    counts = counts.withColumn("coverage_pct", percent(F.col("with_uncertainty"), F.col("total")))
    spread = table_percentiles(
        df.filter(has_uncertainty(column)), column,
        {f"p{p}": p / 100 for p in K.UNCERTAINTY_PERCENTILES}, rows=known)
    return counts.join(F.broadcast(spread), how="left")     # one row on each side


def validity_counts(df: DataFrame, column: str = "CrossSection") -> DataFrame:
    c = F.col(column)
    return df.agg(
        row_count().alias("total"), F.count_if(c > 0).alias("positive"), F.count_if(c == 0).alias("zero"),
        F.count_if(c < 0).alias("negative"), F.count_if(c.isNull()).alias("missing"))


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and missing values per critical column, in one pass, one row per column."""
    out = df.agg(*[
        e for c in columns for e in (
            F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"{c}__inf"),
            F.count_if(F.col(c).isNull()).alias(f"{c}__null"))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__inf").alias("n_inf"), F.col(f"{c}__null").alias("n_null"))
        for c in columns])
    return out.select(F.inline(rows))


def estimate_projectiles(df: DataFrame) -> DataFrame:
    """Likely projectiles from reaction-number ranges, when no column tells."""
    mt = F.col("MT")
    return df.agg(
        row_count().alias("total"), F.count_if((mt >= 1) & (mt < 900)).alias("likely_neutron"),
        F.count_if((mt >= 600) & (mt < 900)).alias("likely_charged"),
        F.count_if(mt >= 9000).alias("likely_covariance"))


# -------------------------------------------------------------- distributions
def _with_share(counts: DataFrame, name: str = "pct") -> DataFrame:
    """Percent of the total of an already aggregated table (a handful of rows)."""
    total = counts.agg(F.sum("count").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn(
        name, percent(F.col("count"), F.col("__total"))).drop("__total")


def type_distribution(df: DataFrame, column: str = "data_type") -> DataFrame:
    return _with_share(df.groupBy(column).agg(row_count().alias("count")))


def removed_types(df: DataFrame) -> DataFrame:
    return df.filter("NOT is_pure").groupBy("data_type").agg(row_count().alias("count"))


def top_counts(df: DataFrame, column: str, k: int, share: str | None = None) -> DataFrame:
    """k most frequent values; ``share`` is 'table' or 'shown' for the base of the percent."""
    counts = df.groupBy(column).agg(row_count().alias("count"))
    best = counts.orderBy(F.col("count").desc(), column).limit(k)
    if share is None:
        return best
    base = (best if share == "shown" else counts).agg(F.sum("count").alias("__total"))
    return best.crossJoin(F.broadcast(base)).withColumn(
        "pct", percent(F.col("count"), F.col("__total"))).drop("__total")


def reaction_type_top(df: DataFrame, column: str = "ReactionType", k: int = 15) -> DataFrame:
    return top_counts(df.filter(F.col(column).isNotNull()), column, k, "shown")


def top_with_other(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """k most frequent values and one row for the rest, when there is a rest."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(row_count().alias("count"))
    best = counts.orderBy(F.col("count").desc(), column).limit(k)
    rest = counts.join(F.broadcast(best), column, "left_anti").agg(F.sum("count").alias("count"))
    other = rest.filter(F.col("count") > 0).select(F.lit("Other").alias(column), "count")
    return best.unionByName(other)


def top_reactions(df: DataFrame, k: int = 20) -> DataFrame:
    return top_counts(df, "MT", k, "table").withColumns(
        {"name": L.mt_name("MT"), "category": L.mt_category("MT")})


def critical_reactions(df: DataFrame, k: int = 20) -> DataFrame:
    """Each reactor-critical reaction with its count when it is among the k most frequent."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(mt,) for mt in K.MT_REACTOR_CORE], "MT int")
    return wanted.join(F.broadcast(top_counts(df, "MT", k)), "MT", "left").select(
        "MT", L.mt_name("MT").alias("name"), F.col("count").isNotNull().alias("in_top"), "count")


# ----------------------------------------------------------------- nuclides
def nuclide_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*NUCLIDE).agg(row_count().alias("count")).withColumn("N", F.col("A") - F.col("Z"))


def nuclide_ranges(df: DataFrame) -> DataFrame:
    return nuclide_counts(df).agg(
        row_count().alias("n_isotopes"), F.min("Z").alias("z_min"), F.max("Z").alias("z_max"),
        F.min("N").alias("n_min"), F.max("N").alias("n_max"), F.min("A").alias("a_min"), F.max("A").alias("a_max"))


def available_nuclides(df: DataFrame) -> DataFrame:
    return df.groupBy(*NUCLIDE).agg(row_count().alias("count")).select(
        "Z", "A", L.element_symbol("Z").alias("symbol"), L.nuclide_label("Z", "A").alias("label"), "count",
    ).orderBy(F.col("count").desc(), "Z", "A")


def available_reactions(df: DataFrame, z: int, a: int) -> DataFrame:
    found = df.filter((F.col("Z") == z) & (F.col("A") == a)).groupBy("MT").agg(row_count().alias("count"))
    if found.isEmpty():
        raise ValueError(f"no measurements of Z={z}, A={a}")
    return found.select("MT", L.mt_name("MT").alias("name"), "count").orderBy(F.col("count").desc(), "MT")


def cascade(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted distinct values of one key level; rows are made distinct before collecting."""
    distinct = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    return distinct.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def nested_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy(*NUCLIDE, "MT").agg(row_count().alias("count"))


def nuclide_extremes(df: DataFrame, k: int = 10) -> DataFrame:
    """The k best and k least measured nuclides with their share of all rows."""
    counts = _with_share(df.groupBy(*NUCLIDE).agg(row_count().alias("count")))
    labelled = counts.withColumn("label", L.nuclide_label("Z", "A"))
    most = labelled.orderBy(F.col("count").desc(), *NUCLIDE).limit(k).withColumn("side", F.lit("top"))
    least = labelled.orderBy("count", *NUCLIDE).limit(k).withColumn("side", F.lit("bottom"))
    return most.unionByName(least)


def nuclide_chart(df: DataFrame) -> DataFrame:
    """Z by N matrix of log10(count + 1), absent cells 0 (columns named by N)."""
    counts = nuclide_counts(df)
    wide = counts.groupBy("Z").pivot("N").agg(F.sum("count")).fillna(0)
    return wide.select("Z", *[
        F.log10(F.col(f"`{c}`") + 1.0).alias(f"n_{c}") for c in wide.columns if c != "Z"])


def nuclide_chart_long(df: DataFrame) -> DataFrame:
    """The same chart, a row per Z and N of the bounding grid."""
    counts = materialize(nuclide_counts(df).select("Z", "N", "count"))
    grid = counts.select("Z").distinct().crossJoin(counts.select("N").distinct())
    return grid.join(counts, ["Z", "N"], "left").select(
        "Z", "N", F.log10(F.coalesce(F.col("count"), F.lit(0)) + 1.0).alias("log_count"))


def gini(df: DataFrame, keys: Sequence[str] = tuple(NUCLIDE)) -> DataFrame:
    """Inequality of row counts over keys.

    Keys with equal counts are combined first: the running rank then goes over distinct
    counts, whose number is at most the square root of twice the rows.
    """
    per = df.groupBy(*keys).agg(row_count().alias("c")).groupBy("c").agg(row_count().alias("m"))
    before = F.coalesce(
        F.sum("m").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c, m, b = F.col("c"), F.col("m"), F.col("__b")
    weighted = c * (m * b + m * (m + 1) / 2.0)
    n, total = F.sum("m"), F.sum(c * m)
    return per.withColumn("__b", before).agg(
        n.alias("n_keys"), (2.0 * F.sum(weighted) / (n * total) - (n + 1) / n).alias("gini"))


# ------------------------------------------------------------------ energies
def energy_regime(energy: Column | str = "Energy") -> Column:
    e = F.col(energy) if isinstance(energy, str) else energy
    (first, limit), *rest = K.ENERGY_REGIMES
    expr = F.when(e < limit, first)
    for name, limit in rest:
        expr = expr.when(e < limit, name)
    return expr.otherwise(K.ENERGY_REGIME_ABOVE)


def energy_region(energy: Column | str = "Energy") -> Column:
    e = F.col(energy) if isinstance(energy, str) else energy
    (first, low, high), *rest = K.ENERGY_REGIONS
    expr = F.when((e >= low) & (e < high), first)
    for name, low, high in rest:
        expr = expr.when((e >= low) & (e < high), name)
    return expr


def regime_breakdown(df: DataFrame) -> DataFrame:
    positive = df.filter(F.col("Energy") > 0)
    return _with_share(positive.groupBy(energy_regime().alias("regime")).agg(
        row_count().alias("count"), F.min("Energy").alias("energy_min"), F.max("Energy").alias("energy_max")))


def energy_spread(df: DataFrame) -> DataFrame:
    positive = df.filter(F.col("Energy") > 0)
    ends = materialize(positive.agg(
        row_count().alias("count"), F.min("Energy").alias("energy_min"), F.max("Energy").alias("energy_max")))
    middle = table_percentiles(positive, "Energy", {"energy_median": 0.5}, rows=ends.first()["count"])
    return ends.crossJoin(F.broadcast(middle))      # one row on each side


def region_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(energy_region().alias("region")).agg(row_count().alias("count"))


def histogram(df: DataFrame, value: Column, bins: int, density: bool = False) -> DataFrame:
    """Equal bins between minimum and maximum; the last bin includes its upper edge.

    Empty bins are rows too. With ``density`` counts are divided by n times the width.
    """
    rows = df.select(value.alias("v")).filter(finite("v"))
    span = materialize(rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), row_count().alias("total")))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = rows.crossJoin(F.broadcast(span)).select(
        F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
        .otherwise(0).alias("bin"))
    counts = placed.groupBy("bin").agg(row_count().alias("count"))
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = frame.join(F.broadcast(counts), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    edges = [
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count"]
    if density:
        edges.append((F.col("count") / (F.col("total") * width)).alias("density"))
    return out.select(*edges)


def log_energy_histogram(df: DataFrame, bins: int = 100) -> DataFrame:
    return histogram(df.filter(F.col("Energy") > 0), F.log10("Energy"), bins)


def z_density_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(df, F.abs("z_score"), bins, density=True)


def iqr_outliers(
    df: DataFrame, mts: Sequence[int] = tuple(K.MT_REACTOR_CORE), min_rows: int = 10, limit: int = PERCENTILE_ROWS
) -> DataFrame:
    """Quartiles and rows above Q3 + 1.5 IQR per reaction with more than ``min_rows`` rows."""
    valid = df.filter(F.col("MT").isin(list(mts)) & (F.col("CrossSection") > 0))
    quartiles = group_percentiles(
        valid, ["MT"], "CrossSection", {"q1": 0.25, "median": 0.5, "q3": 0.75}, limit)
    above = F.col("CrossSection") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return attach(valid, quartiles, ["MT"]).groupBy("MT").agg(
        row_count().alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.count_if(above).alias("n_outliers")).filter(F.col("n") > min_rows)


# --------------------------------------------------------------- experiments
def author_report(df: DataFrame, k: int = 5) -> DataFrame:
    return top_counts(df.filter(F.col("Author").isNotNull()), "Author", k)


def year_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("Year").alias("year_min"), F.max("Year").alias("year_max"))


def entries_report(df: DataFrame, columns: Sequence[str], k: int = 15) -> DataFrame:
    """k entries with most rows and one representative row (the first in value order)."""
    row = F.struct(*columns)
    return df.groupBy("Entry").agg(row_count().alias("count"), F.min(row).alias("__r")).select(
        "Entry", "count", "__r.*").orderBy(F.col("count").desc(), "Entry").limit(k)


# ------------------------------------------------------------- log-E density
def _log_bins(df: DataFrame, keys: Sequence[str], width: float, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with the bin number counted from their group's lowest log energy."""
    rows = df.select(*keys, *extra, F.col("log_E")).filter(finite("log_E"))
    span = rows.groupBy(*keys).agg(F.min("log_E").alias("__lo"), F.max("log_E").alias("__hi"))
    span = span.withColumn("__bins", bin_count(width))
    at = F.floor((F.col("log_E") - F.col("__lo")) / width)
    return attach(rows, span, keys).withColumn("bin", F.greatest(
        F.least(at, F.col("__bins") - 1), F.lit(0)))


def bin_count(width: float, low: str = "__lo", high: str = "__hi") -> Column:
    """Bins of the edge list low, low + width, ... below high + width."""
    return F.ceil((F.col(high) + width - F.col(low)) / width).cast("long") - 1


def energy_density(df: DataFrame, keys: Sequence[str], width: float = 0.5) -> DataFrame:
    """Points per unit log energy in every bin of each group, empty ones included."""
    keys = list(keys)
    binned = _log_bins(df, keys, width)
    counts = binned.groupBy(*keys, "__lo", "__bins", "bin").agg(row_count().alias("n"))
    groups = counts.groupBy(*keys, "__lo", "__bins").agg(F.sum("n").alias("__all"))
    frame = groups.filter("__bins > 0").withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__bins") - 1)))
    out = attach(frame, counts.drop("__lo", "__bins"), [*keys, "bin"])
    return out.select(
        *keys, "bin", (F.col("__lo") + (F.col("bin") + 0.5) * width).alias("bin_center"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / width).alias("density"))


def density_ratio(df: DataFrame, keys: Sequence[str], width: float = 0.5) -> DataFrame:
    filled = energy_density(df, keys, width).filter("density > 0")
    return filled.groupBy(*keys).agg(
        row_count().alias("n_filled"), F.min("density").alias("min_density"), F.max("density").alias("max_density"),
        (F.max("density") / F.min("density")).alias("ratio"))


def sigma_per_bin(df: DataFrame, keys: Sequence[str], width: float = 0.5, sigma: str = "gp_std") -> DataFrame:
    """Mean sigma and point count of every non-empty bin; the last edge falls in the last bin."""
    binned = _log_bins(df, keys, width, [sigma])
    return binned.groupBy(*keys, "bin", "__lo").agg(
        F.avg(sigma).alias("mean_sigma"), row_count().alias("n")).select(
        *keys, "bin", (F.col("__lo") + (F.col("bin") + 0.5) * width).alias("bin_center"), "n", "mean_sigma")


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 3) -> DataFrame:
    """Spearman coefficient per group of a small per-bin table (ties get average ranks)."""
    keys = list(keys)

    def ranks(name: str) -> Column:
        by = Window.partitionBy(*keys).orderBy(name)
        ties = Window.partitionBy(*keys, name)
        return F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2.0

    ranked = df.select(*keys, ranks(x).alias("__x"), ranks(y).alias("__y"))
    return ranked.groupBy(*keys).agg(row_count().alias("n_bins"), F.corr("__x", "__y").alias("correlation")).filter(
        F.col("n_bins") >= min_rows)


def density_sigma_correlation(df: DataFrame, keys: Sequence[str], width: float = 0.5) -> DataFrame:
    """Rank correlation of bin density and mean sigma over the non-empty bins."""
    bins = sigma_per_bin(df, keys, width).withColumn("density", F.col("n") / width)
    return rank_correlation(bins, keys, "density", "mean_sigma")


def calibration_groups(df: DataFrame, keys: Sequence[str], sigma: str = "gp_std") -> DataFrame:
    return df.groupBy(*keys).agg(
        row_count().alias("n_points"), F.min("log_E").alias("log_e_min"), F.max("log_E").alias("log_e_max"),
        F.min(sigma).alias("sigma_min"), F.max(sigma).alias("sigma_max"),
        F.when(F.min(sigma) > 0, F.max(sigma) / F.min(sigma)).alias("sigma_ratio"),
        F.avg(sigma).alias("sigma_mean"), F.stddev_pop(sigma).alias("sigma_std"))


def calibration_diagnosis(df: DataFrame, keys: Sequence[str], width: float = 0.5) -> DataFrame:
    """Mean correlation and mean sigma ratio over groups, with the findings they imply."""
    correlations = density_sigma_correlation(df, keys, width).agg(F.avg("correlation").alias("mean_correlation"))
    ratios = calibration_groups(df, keys).agg(F.avg("sigma_ratio").alias("mean_ratio"))
    return correlations.crossJoin(ratios).withColumns({
        "weak_correlation": F.col("mean_correlation") > -0.3,
        "low_range": F.col("mean_ratio") < 2.0,
    })


def sigma_coverage(df: DataFrame, z: str = "z_score") -> DataFrame:
    """Share of rows within 1, 2, 3 sigma next to the normal expectation."""
    valid = df.filter(finite(z)).select(F.abs(z).alias("a"), F.col(z).alias("z"))
    return valid.agg(
        row_count().alias("n_valid"), F.avg("a").alias("z_mean"), F.stddev_pop("z").alias("z_std"),
        *[F.avg((F.col("a") <= float(k)).cast("double")).alias(f"coverage_{k}sigma") for k in (1, 2, 3)],
        *[F.lit(v).alias(f"expected_{k}sigma") for k, v in K.NORMAL_COVERAGE.items()])


def coverage_curve(df: DataFrame, z: str = "z_score", levels: int = 50, top: float = 5.0) -> DataFrame:
    """Share of |z| at or below each of the evenly spaced levels 0..top.

    Every row is placed on the first level that covers it; a running sum over the fifty
    levels then gives the curve, so rows are counted once rather than once per level.
    """
    step = top / (levels - 1)
    a = F.abs(z)
    # Start from the division and settle rounding by comparing with the level itself.
    guess = F.greatest(F.ceil(a / step), F.lit(0))
    guess = F.when((guess > 0) & (a <= (guess - 1) * step), guess - 1).when(a > guess * step, guess + 1).otherwise(guess)
    placed = df.filter(finite(z)).groupBy(F.least(guess, F.lit(levels)).alias("level")).agg(row_count().alias("n"))
    frame = df.sparkSession.range(levels + 1).select(F.col("id").alias("level"))
    filled = frame.join(F.broadcast(placed), "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    run = filled.select(
        "level", F.sum("n").over(Window.orderBy("level")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return run.filter(F.col("level") < levels).select(
        "level", (F.col("level") * step).alias("sigma"), (F.col("upto") / F.col("all")).alias("coverage"))


# ------------------------------------------------------------------ training
def training_units(df: DataFrame, keys: Sequence[str] = ("Z", "A", "MT"), limit: int = TASK_ROWS) -> DataFrame:
    """Energy-ordered value arrays per unit, in numbered parts of at most about ``limit`` rows.

    An array is a cell in one task's memory, so a hot unit is cut along energy; parts read
    in order give the whole unit.
    """
    from crossfield.plans.ordering import with_tiles

    tiled = with_tiles(df.filter(F.col("Energy").isNotNull()), keys, "Energy", limit)
    point = F.struct("Energy", "CrossSection")
    out = tiled.groupBy(*keys, F.col("__tile").alias("part")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    return out.select(
        *keys, "part", F.size("p").alias("n"), F.col("p.Energy").alias("energies"),
        F.col("p.CrossSection").alias("targets"))


def with_logs(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_E": clipped_log10("Energy"), "log_sigma": clipped_log10("CrossSection")})


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = TASK_ROWS) -> DataFrame:
    """Groups too large for one task, with their sizes."""
    return group_sizes(df, keys, limit).table.filter(F.col("group_rows") > limit)
