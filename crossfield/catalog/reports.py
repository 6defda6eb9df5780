"""Queries of profiling, scoring and ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.catalog.base import (
    FULL_KEYS, KEYS, clean, measurements, r, register, round_columns, rounded, scored, table,
)
from crossfield.catalog.rows import _CATEGORY_SQL, _FLAG_SQL, classified, values
from crossfield.operators import outliers, profile as P, quality, ranking
from crossfield.operators.select import Selection

_NAMES = values(K.MT_NAMES)
_SYM = values({i + 1: s for i, s in enumerate(K.ELEMENT_SYMBOLS)})
_LABEL = "coalesce(sym, 'Z' || Z) || '-' || A"
CALIBRATION = ["Z", "MT"]
K3 = "Z, A, MT"


def pct(part: str, whole: str) -> str:
    return r(f"100.0::DOUBLE * {part} / {whole}")


# ------------------------------------------------------------------- profiles
@register("a19_nuclide_counts", """
SELECT Z, A, N, count(*) AS count FROM q WHERE Energy BETWEEN 1e6 AND 9e6 AND MT IN (16, 18, 102)
GROUP BY ALL ORDER BY count DESC, Z, A LIMIT 20""")
def nuclide_counts(spark, sf):
    wanted = Selection(energy_min=1e6, energy_max=9e6, mt_mode="custom", custom_mt=[16, 18, 102])
    rows = clean(spark, sf).filter(wanted.scan_predicate())
    return ranking.top_k(P.nuclide_counts(rows), "count", 20, ["Z", "A"])


@register("a19_nuclide_ranges", """
SELECT count(*) AS n_isotopes, min(Z) AS z_min, max(Z) AS z_max, min(N) AS n_min, max(N) AS n_max, min(A) AS a_min, max(A) AS a_max
FROM (SELECT DISTINCT Z, A, A - Z AS N FROM m)""")
def nuclide_ranges(spark, sf):
    return P.nuclide_ranges(measurements(spark, sf))


@register("a01_outlier_summary", f"""
SELECT t AS threshold, count(*) FILTER (z_score > t) AS outliers, {pct('count(*) FILTER (z_score > t)', 'count(*)')} AS pct,
       count(*) - count(*) FILTER (z_score > t) AS retained FROM s, (VALUES (2.0::DOUBLE), (3.0), (4.0), (5.0)) v(t) GROUP BY t""", scored=True)
def outlier_summary(spark, sf):
    return round_columns(P.outlier_summary(scored(spark, sf)), "pct")


@register("a02_experiment_summary", f"""
SELECT n_experiments, n_discrepant, {pct('n_discrepant', 'n_experiments')} AS pct_discrepant, n_points_in_discrepant,
       {pct('n_points_in_discrepant', 'n')} AS pct_points_affected FROM (
  SELECT count(DISTINCT Entry) AS n_experiments, count(DISTINCT Entry) FILTER (experiment_outlier) AS n_discrepant,
         count(*) FILTER (experiment_outlier) AS n_points_in_discrepant, count(*) AS n FROM s)""", scored=True)
def experiment_summary(spark, sf):
    return round_columns(P.experiment_summary(scored(spark, sf)), "pct_discrepant", "pct_points_affected")


@register("a03_dataset_statistics", """
SELECT count(*) AS n_points, count(DISTINCT (Z, A)) AS n_isotopes, count(DISTINCT MT) AS n_reactions, min(Energy) AS energy_min,
       max(Energy) AS energy_max, min(CrossSection) AS xs_min, max(CrossSection) AS xs_max FROM m""")
def dataset_statistics(spark, sf):
    return P.dataset_statistics(measurements(spark, sf))


@register("a04_ingest_summary", f"""
SELECT count(*) AS n_points, count(DISTINCT (Z, A)) AS n_isotopes, count(DISTINCT MT) AS n_reactions, min(Energy) AS energy_min,
       max(Energy) AS energy_max, {pct('count(Uncertainty)', 'count(*)')} AS uncertainty_pct,
       {pct('count(Energy_Uncertainty)', 'count(*)')} AS energy_uncertainty_pct FROM q""")
def ingest_summary(spark, sf):
    return round_columns(P.ingest_summary(clean(spark, sf)), "uncertainty_pct", "energy_uncertainty_pct")


@register("a05_unit_sanity", f"""
SELECT {r('quantile_cont(Energy, 0.5)')} AS median_energy, {r('quantile_cont(CrossSection, 0.5)')} AS median_xs,
       'ok' AS energy_check, 'ok' AS xs_check FROM m""")
def unit_sanity(spark, sf):
    return round_columns(quality.unit_sanity(measurements(spark, sf)), "median_energy", "median_xs")


@register("a06_type_distribution", _FLAG_SQL + f" SELECT data_type, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM k GROUP BY data_type")
def type_distribution(spark, sf):
    return round_columns(P.type_distribution(classified(spark, sf)), "pct")


@register("a07_removed_types", _FLAG_SQL + " SELECT data_type, count(*) AS count FROM k WHERE NOT is_pure GROUP BY data_type")
def removed_types(spark, sf):
    return P.removed_types(classified(spark, sf))


@register("a08_reaction_type_top", f"""
, t AS (SELECT sf8 AS ReactionType, count(*) AS count FROM m WHERE sf8 IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT ReactionType, count, {pct('count', 'sum(count) OVER ()')} AS pct FROM t""")
def reaction_type_top(spark, sf):
    rows = measurements(spark, sf).withColumnRenamed("sf8", "ReactionType")
    return round_columns(P.reaction_type_top(rows, k=5), "pct")


@register("a09_available_nuclides", f"""
SELECT Z, A, coalesce(sym, 'Z' || Z) AS symbol, {_LABEL} AS label, count(*) AS count
FROM m LEFT JOIN (VALUES {_SYM}) t(zz, sym) ON Z = zz GROUP BY ALL""")
def available_nuclides(spark, sf):
    return P.available_nuclides(measurements(spark, sf))


@register("a10_available_reactions", f"SELECT MT, name, count(*) AS count FROM m JOIN (VALUES {_NAMES}) t(code, name) ON MT = code WHERE Z = 3 AND A = 7 GROUP BY ALL")
def available_reactions(spark, sf):
    return P.available_reactions(measurements(spark, sf), 3, 7)


@register("a11_cascade_lookups", """
SELECT 'Z>A' AS level, Z, -1 AS A, list_sort(list(DISTINCT CAST(A AS STRING))) AS values FROM m GROUP BY Z
UNION ALL SELECT 'Z,A>Projectile', Z, A, list_sort(list(DISTINCT Projectile)) FROM m GROUP BY Z, A
UNION ALL SELECT 'Z,A>MT', Z, A, list_sort(list(DISTINCT CAST(MT AS STRING))) FROM m GROUP BY Z, A""")
def cascade_lookups(spark, sf):
    rows = measurements(spark, sf).withColumns({"a_text": F.col("A").cast("string"), "mt_text": F.col("MT").cast("string")})
    first = P.cascade(rows, ["Z"], "a_text").select(F.lit("Z>A").alias("level"), "Z", F.lit(-1).alias("A"), "values")
    for name, value in (("Z,A>Projectile", "Projectile"), ("Z,A>MT", "mt_text")):
        first = first.unionByName(P.cascade(rows, ["Z", "A"], value).withColumn("level", F.lit(name)))
    return first.withColumn("values", F.col("values"))


@register("a12_group_statistics", f"""
SELECT {K3}, count(*) AS total, count(*) FILTER (z_score > 3) AS n_outliers, count(*) FILTER (z_score <= 3) AS n_inliers,
  count(*) FILTER (z_score <= 3 AND NOT experiment_outlier AND coalesce(sf8 NOT LIKE '%RAW%', true)) AS n_remaining,
  {r('min(z_score)', 4)} AS z_min, {r('max(z_score)', 4)} AS z_max, count(DISTINCT Entry) AS n_experiments,
  count(DISTINCT Entry) FILTER (experiment_outlier) AS n_discrepant, count(*) FILTER (experiment_outlier) AS n_points_in_discrepant,
  {pct('count(*) FILTER (z_score > 3)', 'count(*)')} AS pct_outliers, {pct('count(*) FILTER (z_score <= 3)', 'count(*)')} AS pct_inliers,
  {pct("count(*) FILTER (z_score <= 3 AND NOT experiment_outlier AND coalesce(sf8 NOT LIKE '%RAW%', true))", 'count(*)')} AS pct_remaining
FROM s GROUP BY ALL""", scored=True)
def group_statistics(spark, sf):
    out = P.group_statistics(scored(spark, sf), KEYS)
    out = round_columns(out, "z_min", "z_max", digits=4)
    return round_columns(out, "pct_outliers", "pct_inliers", "pct_remaining")


_QUANTS = ", ".join(f"{r(f'quantile_cont(Uncertainty, {p / 100}) FILTER (Uncertainty > 0)')} AS p{p}" for p in K.UNCERTAINTY_PERCENTILES)


@register("a13_uncertainty_coverage", f"""
SELECT count(*) AS total, count(*) FILTER (Uncertainty > 0) AS with_uncertainty,
       {pct('count(*) FILTER (Uncertainty > 0)', 'count(*)')} AS coverage_pct, {_QUANTS} FROM m""")
def uncertainty_coverage(spark, sf):
    names = [f"p{p}" for p in K.UNCERTAINTY_PERCENTILES]
    return round_columns(P.uncertainty_coverage(measurements(spark, sf)), "coverage_pct", *names)


@register("a14_validity_counts", """
SELECT count(*) AS total, count(*) FILTER (CrossSection > 0) AS positive, count(*) FILTER (CrossSection = 0) AS zero,
       count(*) FILTER (CrossSection < 0) AS negative, count(*) FILTER (CrossSection IS NULL) AS missing FROM m""")
def validity_counts(spark, sf):
    return P.validity_counts(measurements(spark, sf))


@register("a15_top_with_other", """
, c AS (SELECT Entry, count(*) AS count FROM m GROUP BY 1), t AS (SELECT * FROM c ORDER BY count DESC, Entry LIMIT 8)
SELECT * FROM t UNION ALL SELECT 'Other', CAST(sum(count) AS BIGINT) FROM c WHERE Entry NOT IN (SELECT Entry FROM t) HAVING sum(count) > 0""")
def top_with_other(spark, sf):
    return P.top_with_other(measurements(spark, sf), "Entry")


@register("a16_projectile_estimate", """
SELECT count(*) AS total, count(*) FILTER (x BETWEEN 1 AND 899) AS likely_neutron, count(*) FILTER (x BETWEEN 600 AND 899) AS likely_charged,
       count(*) FILTER (x >= 9000) AS likely_covariance FROM (SELECT l_partkey * 7 % 9200 AS x FROM lineitem)""")
def projectile_estimate(spark, sf):
    return P.estimate_projectiles(table(spark, sf, "lineitem").select((F.col("l_partkey") * 7 % 9200).alias("MT")))


@register("a17_top_reactions", f"""
, x AS (SELECT CAST(l_partkey % 120 AS INT) AS mt, count(*) AS count FROM lineitem GROUP BY 1)
SELECT mt AS MT, count, {pct('count', '(SELECT sum(count) FROM x)')} AS pct, coalesce(name, 'Unknown (MT ' || mt || ')') AS name, {_CATEGORY_SQL} AS category
FROM (SELECT * FROM x ORDER BY count DESC, mt LIMIT 20) LEFT JOIN (VALUES {_NAMES}) t(code, name) ON mt = code""")
def top_reactions(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 120).cast("int").alias("MT"))
    return round_columns(P.top_reactions(rows), "pct")


@register("a18_critical_reactions", f"""
, t AS (SELECT MT, count(*) AS count FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT code AS MT, name, t.count IS NOT NULL AS in_top, t.count FROM (VALUES {_NAMES}) v(code, name) LEFT JOIN t ON t.MT = code
WHERE code IN (2, 4, 16, 18, 102, 103, 107)""")
def critical_reactions(spark, sf):
    return P.critical_reactions(measurements(spark, sf))


_CHART = ", ".join(f"{r(f'log10(count(*) FILTER (A - Z = {n}) + 1.0)')} AS n_{n}" for n in range(10))


@register("a20_nuclide_chart", f"SELECT Z, {_CHART} FROM m GROUP BY Z")
def nuclide_chart(spark, sf):
    out = P.nuclide_chart(measurements(spark, sf))
    return round_columns(out, *[c for c in out.columns if c != "Z"])


@register("a20_nuclide_chart_long", f"""
SELECT Z, N, {r('log10(coalesce(c, 0) + 1.0)')} AS log_count FROM (SELECT DISTINCT Z FROM m), (SELECT DISTINCT A - Z AS N FROM m)
LEFT JOIN (SELECT Z AS zz, A - Z AS nn, count(*) AS c FROM m GROUP BY ALL) ON Z = zz AND N = nn""")
def nuclide_chart_long(spark, sf):
    return round_columns(P.nuclide_chart_long(measurements(spark, sf)), "log_count")


_REGIME = "CASE WHEN Energy < 1 THEN 'thermal' WHEN Energy < 1e4 THEN 'resonance' WHEN Energy < 2e7 THEN 'fast' ELSE 'ultra_fast' END"


@register("a21_regime_breakdown", f"""
, e AS (SELECT Energy / 1e6 * Z * Z * Z * Z * A * 20 AS Energy FROM m)
SELECT {_REGIME} AS regime, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct,
       {r('min(Energy)', 3)} AS energy_min, {r('max(Energy)', 3)} AS energy_max FROM e WHERE Energy > 0 GROUP BY regime""")
def regime_breakdown(spark, sf):
    rows = measurements(spark, sf).select((F.expr("Energy / 1e6D * Z * Z * Z * Z * A * 20")).alias("Energy"))
    return round_columns(round_columns(P.regime_breakdown(rows), "pct"), "energy_min", "energy_max", digits=3)


@register("a21_energy_spread", f"SELECT count(*) AS count, min(Energy) AS energy_min, max(Energy) AS energy_max, {r('quantile_cont(Energy, 0.5)')} AS energy_median FROM m")
def energy_spread(spark, sf):
    return round_columns(P.energy_spread(measurements(spark, sf)), "energy_median")


@register("a22_energy_regions", """
SELECT CASE WHEN e >= 1e-5 AND e < 0.625 THEN 'Thermal' WHEN e >= 0.625 AND e < 1e3 THEN 'Epithermal' WHEN e >= 1e3 AND e < 1e5 THEN 'Resonance'
            WHEN e >= 1e5 AND e < 2e7 THEN 'Fast' END AS region, count(*) AS count
FROM (SELECT l_discount * l_extendedprice * l_discount AS e FROM lineitem) GROUP BY region""")
def energy_regions(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") * F.col("l_extendedprice") * F.col("l_discount")).alias("Energy"))
    return P.region_counts(rows)


@register("a23_log_energy_histogram", f"""
, e AS (SELECT log10(Energy) AS v FROM m WHERE Energy > 0), h AS (SELECT min(v) AS lo, (max(v) - min(v)) / 40 AS w FROM e),
c AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 39) AS bin, count(*) AS n FROM e, h GROUP BY 1)
SELECT b AS bin, {r('lo + b * w')} AS bin_start, {r('lo + (b + 1) * w')} AS bin_end, coalesce(n, 0) AS count
FROM range(40) t(b), h LEFT JOIN c ON c.bin = b""")
def log_energy_histogram(spark, sf):
    return round_columns(P.log_energy_histogram(measurements(spark, sf), 40), "bin_start", "bin_end")


@register("a24_iqr_outliers", f"""
, v AS (SELECT MT, quantile_cont(CrossSection, 0.25) AS q1, quantile_cont(CrossSection, 0.5) AS median, quantile_cont(CrossSection, 0.75) AS q3
        FROM m WHERE CrossSection > 0 GROUP BY MT)
SELECT MT, count(*) AS n, {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3,
       count(*) FILTER (CrossSection > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM m JOIN v USING (MT) WHERE CrossSection > 0 GROUP BY MT HAVING count(*) > 10""")
def iqr_outliers(spark, sf):
    return round_columns(P.iqr_outliers(measurements(spark, sf)), "q1", "median", "q3")


@register("a25_nuclide_extremes", f"""
, c AS (SELECT Z, A, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM m GROUP BY Z, A),
b AS ((SELECT *, 'top' AS side FROM c ORDER BY count DESC, Z, A LIMIT 10) UNION ALL (SELECT *, 'bottom' FROM c ORDER BY count, Z, A LIMIT 10))
SELECT Z, A, count, pct, {_LABEL} AS label, side FROM b LEFT JOIN (VALUES {_SYM}) t(zz, sym) ON Z = zz""")
def nuclide_extremes(spark, sf):
    return round_columns(P.nuclide_extremes(measurements(spark, sf)), "pct")


@register("a26_gini", f"""
SELECT count(*) AS n_keys, {r('2 * sum(i * c)::DOUBLE / (count(*) * sum(c)) - (count(*) + 1) / count(*)::DOUBLE')} AS gini
FROM (SELECT c, row_number() OVER (ORDER BY c) AS i FROM (SELECT count(*) AS c FROM m GROUP BY Z, A))""")
def gini(spark, sf):
    return round_columns(P.gini(measurements(spark, sf)), "gini")


@register("a27_nested_breakdown", "SELECT Z, A, MT, count(*) AS count FROM m GROUP BY ALL")
def nested_breakdown(spark, sf):
    return P.nested_breakdown(measurements(spark, sf))


@register("a28_quality_report", """
SELECT 'Energy' AS "column", count(*) FILTER (isinf(Energy)) AS n_inf, count(*) FILTER (Energy IS NULL) AS n_null FROM m
UNION ALL SELECT 'CrossSection', count(*) FILTER (isinf(CrossSection)), count(*) FILTER (CrossSection IS NULL) FROM m
UNION ALL SELECT 'Uncertainty', count(*) FILTER (isinf(Uncertainty)), count(*) FILTER (Uncertainty IS NULL) FROM m""")
def quality_report(spark, sf):
    return P.quality_report(measurements(spark, sf), ["Energy", "CrossSection", "Uncertainty"])


def _authored(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("Author "), F.col("o_custkey") % 40).alias("Author"), F.year("o_orderdate").alias("Year"))


@register("a29_author_report", "SELECT 'Author ' || (o_custkey % 40) AS Author, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def author_report(spark, sf):
    return P.author_report(_authored(spark, sf))


@register("a29_year_range", "SELECT CAST(min(year(o_orderdate)) AS INT) AS year_min, CAST(max(year(o_orderdate)) AS INT) AS year_max FROM orders")
def year_range(spark, sf):
    return P.year_range(_authored(spark, sf))


@register("a30_entries_report", """
SELECT Entry, count(*) AS count, min((MT, Energy, CrossSection)).MT AS MT, min((MT, Energy, CrossSection)).Energy AS Energy,
       min((MT, Energy, CrossSection)).CrossSection AS CrossSection
FROM (SELECT Entry, {'MT': MT, 'Energy': Energy, 'CrossSection': CrossSection} AS row, * FROM m) GROUP BY Entry ORDER BY 2 DESC, 1 LIMIT 15""".replace(
    "min((MT, Energy, CrossSection))", "min(row)"))
def entries_report(spark, sf):
    return P.entries_report(measurements(spark, sf), ["MT", "Energy", "CrossSection"])


_BINS = """
, sp AS (SELECT Z, MT, min(log_E) AS lo, max(log_E) AS hi, CAST(ceil((max(log_E) + 0.1::DOUBLE - min(log_E)) / 0.1::DOUBLE) AS BIGINT) - 1 AS bins FROM s GROUP BY Z, MT),
pl AS (SELECT s.*, lo, bins, greatest(least(CAST(floor((log_E - lo) / 0.1::DOUBLE) AS BIGINT), bins - 1), 0) AS bin FROM s JOIN sp USING (Z, MT)),
bn AS (SELECT Z, MT, bin, any_value(lo) AS lo, count(*) AS n, avg(gp_std) AS mean_sigma FROM pl GROUP BY Z, MT, bin),
rk AS (SELECT Z, MT, rank() OVER (PARTITION BY Z, MT ORDER BY n) + (count(*) OVER (PARTITION BY Z, MT, n) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY Z, MT ORDER BY mean_sigma) + (count(*) OVER (PARTITION BY Z, MT, mean_sigma) - 1) / 2.0 AS ry FROM bn),
co AS (SELECT Z, MT, count(*) AS n_bins, corr(rx, ry) AS correlation FROM rk GROUP BY Z, MT HAVING count(*) >= 3),
cg AS (SELECT Z, MT, count(*) AS n_points, min(log_E) AS log_e_min, max(log_E) AS log_e_max, min(gp_std) AS sigma_min, max(gp_std) AS sigma_max,
              max(gp_std) / min(gp_std) AS sigma_ratio, avg(gp_std) AS sigma_mean, stddev_pop(gp_std) AS sigma_std FROM s GROUP BY Z, MT)"""


@register("a31_energy_density", _BINS + f"""
SELECT Z, MT, b AS bin, {r('lo + (b + 0.5) * 0.1::DOUBLE')} AS bin_center, coalesce(n, 0) AS n, {r('coalesce(n, 0) / 0.1::DOUBLE')} AS density
FROM (SELECT Z, MT, lo, unnest(range(bins)) AS b FROM sp) LEFT JOIN (SELECT Z, MT, bin AS b, n FROM bn) USING (Z, MT, b)""", scored=True)
def energy_density(spark, sf):
    rows = P.with_logs(clean(spark, sf))
    return round_columns(P.energy_density(rows, CALIBRATION, 0.1), "bin_center", "density")


@register("a31_density_ratio", _BINS + f"""
SELECT Z, MT, count(*) AS n_filled, {r('min(n) / 0.1::DOUBLE')} AS min_density, {r('max(n) / 0.1::DOUBLE')} AS max_density,
       {r('(max(n) / 0.1::DOUBLE) / (min(n) / 0.1::DOUBLE)')} AS ratio FROM bn GROUP BY ALL""", scored=True)
def density_ratio(spark, sf):
    return round_columns(P.density_ratio(P.with_logs(clean(spark, sf)), CALIBRATION, 0.1), "min_density", "max_density", "ratio")


@register("a32_sigma_per_bin", _BINS + f" SELECT Z, MT, bin, {r('lo + (bin + 0.5) * 0.1::DOUBLE')} AS bin_center, n, {r('mean_sigma')} AS mean_sigma FROM bn", scored=True)
def sigma_per_bin(spark, sf):
    return round_columns(P.sigma_per_bin(scored(spark, sf), CALIBRATION, 0.1), "bin_center", "mean_sigma")


# The rank correlation itself takes the bin counts of log energy against the summed energy.
@register("a33_rank_correlation", _BINS + f" SELECT Z, MT, n_bins, {r('correlation', 4)} AS correlation FROM co", scored=True)
def rank_correlation(spark, sf):
    return round_columns(P.density_sigma_correlation(scored(spark, sf), CALIBRATION, 0.1), "correlation", digits=4)


@register("a34_calibration_groups", _BINS + f"""
SELECT Z, MT, n_points, {r('log_e_min')} AS log_e_min, {r('log_e_max')} AS log_e_max, {r('sigma_min')} AS sigma_min, {r('sigma_max')} AS sigma_max,
       {r('sigma_ratio')} AS sigma_ratio, {r('sigma_mean')} AS sigma_mean, {r('sigma_std')} AS sigma_std FROM cg""", scored=True)
def calibration_groups(spark, sf):
    return round_columns(P.calibration_groups(scored(spark, sf), CALIBRATION), "log_e_min", "log_e_max", "sigma_min", "sigma_max", "sigma_ratio", "sigma_mean", "sigma_std")


@register("a35_outlier_rates", f"""
SELECT count(*) AS n_total_points, count(DISTINCT Entry) AS n_experiments, count(*) FILTER (point_outlier) AS n_point_outliers,
       {r('count(*) FILTER (point_outlier) / count(*)::DOUBLE')} AS point_outlier_rate, count(DISTINCT Entry) FILTER (experiment_outlier) AS n_exp_outliers,
       {r('count(DISTINCT Entry) FILTER (experiment_outlier) / count(DISTINCT Entry)::DOUBLE')} AS exp_outlier_rate FROM s""", scored=True)
def outlier_rates(spark, sf):
    return round_columns(P.outlier_rates(scored(spark, sf)), "point_outlier_rate", "exp_outlier_rate")


@register("a36_sigma_coverage", f"""
SELECT count(*) AS n_valid, {r('avg(abs(z_score))')} AS z_mean, {r('stddev_pop(z_score)')} AS z_std,
       {", ".join(f"{r(f'avg(CASE WHEN abs(z_score) <= {k} THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage_{k}sigma" for k in (1, 2, 3))},
       {", ".join(f"{v!r}::DOUBLE AS expected_{k}sigma" for k, v in K.NORMAL_COVERAGE.items())} FROM s""", scored=True)
def sigma_coverage(spark, sf):
    return round_columns(P.sigma_coverage(scored(spark, sf)), "z_mean", "z_std", *[f"coverage_{k}sigma" for k in (1, 2, 3)])


@register("a43_training_units", f"SELECT Z, A, MT, count(*) AS n, {r('min(Energy)', 2)} AS first_energy, {r('sum(CrossSection)', 4)} AS total FROM q GROUP BY ALL")
def training_units(spark, sf):
    units = P.training_units(clean(spark, sf))
    total = F.aggregate("targets", F.lit(0.0), lambda acc, v: acc + v)
    return units.groupBy(*KEYS).agg(F.sum("n").alias("n"), rounded(F.min(F.col("energies")[0]), 2).alias("first_energy"), rounded(F.sum(total), 4).alias("total"))


@register("a44_retained_share", f"""
SELECT count(*) AS initial, count(*) FILTER (Projectile <> 'n') AS removed_projectile,
       count(*) FILTER (Projectile = 'n' AND NOT (Energy BETWEEN 1e6 AND 9e6)) AS removed_energy,
       count(*) FILTER (Projectile = 'n' AND Energy BETWEEN 1e6 AND 9e6 AND NOT CrossSection > 0) AS removed_valid,
       count(*) FILTER (Projectile = 'n' AND Energy BETWEEN 1e6 AND 9e6 AND CrossSection > 0) AS final,
       {r("count(*) FILTER (Projectile = 'n' AND Energy BETWEEN 1e6 AND 9e6 AND CrossSection > 0) / count(*)::DOUBLE")} AS retained_share FROM m""")
def retained_share(spark, sf):
    stages = {"projectile": F.col("Projectile") == "n", "energy": F.col("Energy").between(1e6, 9e6), "valid": F.col("CrossSection") > 0}
    return round_columns(quality.stage_counts(measurements(spark, sf), stages), "retained_share")


@register("a46_coverage_curve", f"""
SELECT k AS level, {r('k * (5.0::DOUBLE / 49)')} AS sigma, {r('count(*) FILTER (abs(z_score) <= k * (5.0::DOUBLE / 49)) / count(*)::DOUBLE')} AS coverage
FROM s, range(50) t(k) GROUP BY k""", scored=True)
def coverage_curve(spark, sf):
    return round_columns(P.coverage_curve(scored(spark, sf)), "sigma", "coverage")


@register("a47_z_density_histogram", f"""
, e AS (SELECT abs(z_score) AS v FROM s), h AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w, count(*) AS total FROM e),
c AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 49) AS bin, count(*) AS n FROM e, h GROUP BY 1)
SELECT b AS bin, {r('lo + b * w')} AS bin_start, {r('lo + (b + 1) * w')} AS bin_end, coalesce(n, 0) AS count, {r('coalesce(n, 0) / (total * w)')} AS density
FROM range(50) t(b), h LEFT JOIN c ON c.bin = b""", scored=True)
def z_density(spark, sf):
    return round_columns(P.z_density_histogram(scored(spark, sf)), "bin_start", "bin_end", "density")


@register("a48_calibration_diagnosis", _BINS + f"""
SELECT {r('c', 4)} AS mean_correlation, {r('ra', 4)} AS mean_ratio, c > -0.3 AS weak_correlation, ra < 2.0 AS low_range
FROM (SELECT avg(correlation) AS c FROM co), (SELECT avg(sigma_ratio) AS ra FROM cg)""", scored=True)
def diagnosis(spark, sf):
    return round_columns(P.calibration_diagnosis(scored(spark, sf), CALIBRATION, 0.1), "mean_correlation", "mean_ratio", digits=4)


@register("f31_group_state", "SELECT Z, A, MT, count(*) AS n, CASE WHEN count(*) = 1 THEN 'single' ELSE 'constant' END AS state FROM s GROUP BY ALL", scored=True)
def group_state(spark, sf):
    return P.group_state(scored(spark, sf), KEYS)


# The full scorer fits a trend from ten rows on and takes median and MAD below; a share of each
# nuclide's experiments is set apart, so that all three states occur.
_APART = "CASE WHEN CAST(Entry AS INT) % 50 < 3 THEN 1000 * (1 + CAST(Entry AS INT) % 50) ELSE 0 END"


@register("f31_state_of_full_scores", f"""
, g AS (SELECT Z, A + {_APART} AS A, MT, Projectile, count(*) AS n FROM q GROUP BY ALL)
SELECT *, CASE WHEN n = 1 THEN 'single' WHEN n < 10 THEN 'constant' ELSE 'full' END AS state FROM g""")
def full_state(spark, sf):
    rows = clean(spark, sf).withColumn("A", F.expr(f"A + {_APART}"))
    return P.group_state(outliers.score(rows), [*KEYS, "Projectile"])


# -------------------------------------------------------------------- scoring
@register("w02_median_scores", f"SELECT Entry, Z, A, MT, Energy, {r('gp_mean', 5)} AS gp_mean, {r('gp_std', 5)} AS gp_std, {r('z_score', 5)} AS z_score FROM s", scored=True)
def median_scores(spark, sf):
    rows = outliers.prepare(clean(spark, sf), outliers.OutlierConfig())
    out = outliers.score_by_median(rows, KEYS)
    return round_columns(out.select("Entry", *KEYS, "Energy", "gp_mean", "gp_std", "z_score"), "gp_mean", "gp_std", "z_score", digits=5)


_FIT_WEIGHTS = """
, w0 AS (SELECT *, coalesce(Uncertainty > 0, false) AS has_unc, CASE WHEN coalesce(Uncertainty > 0, false)
    THEN 1.0::DOUBLE / (least(greatest(0.434::DOUBLE * Uncertainty / CrossSection, 0.005::DOUBLE), 0.5::DOUBLE)
                      * least(greatest(0.434::DOUBLE * Uncertainty / CrossSection, 0.005::DOUBLE), 0.5::DOUBLE)) ELSE 1.0::DOUBLE END AS w,
    log10(Energy) AS x, log10(CrossSection) AS y FROM q),
w1 AS (SELECT Z, A, MT, Projectile, quantile_cont(w, 0.5) AS mid, avg(has_unc::INT) AS share FROM w0 GROUP BY ALL),
wt AS (SELECT w0.*, CASE WHEN share >= 0.1 THEN least(greatest(w, mid / 100), mid * 100) END AS fit_weight FROM w0 JOIN w1 USING (Z, A, MT, Projectile))"""


@register("w03_fit_weights", _FIT_WEIGHTS + f" SELECT Z, A, MT, Projectile, count(fit_weight) AS n, {r('avg(fit_weight)', 3)} AS mean, {r('min(fit_weight)', 3)} AS low, {r('max(fit_weight)', 3)} AS high FROM wt GROUP BY ALL")
def fit_weights(spark, sf):
    out = outliers.add_fit_weights(clean(spark, sf), FULL_KEYS).groupBy(*FULL_KEYS).agg(
        F.count("fit_weight").alias("n"), F.avg("fit_weight").alias("mean"), F.min("fit_weight").alias("low"), F.max("fit_weight").alias("high"))
    return round_columns(out, "mean", "low", "high", digits=3)


@register("w09_point_flags", "SELECT Z, MT, count(*) AS n, count(*) FILTER (point_outlier) AS n_outliers FROM s GROUP BY ALL", scored=True)
def point_flags(spark, sf):
    return outliers.flag_points(scored(spark, sf), "gp_mean", "gp_std").groupBy("Z", "MT").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("point_outlier").alias("n_outliers"))


@register("w10_experiment_flags", "SELECT Z, A, MT, Entry, count(*) AS n FROM s WHERE experiment_outlier GROUP BY ALL", scored=True)
def experiment_flags(spark, sf):
    return scored(spark, sf).filter("experiment_outlier").groupBy(*KEYS, "Entry").agg(F.count(F.lit(1)).alias("n"))


@register("w12_bands", f"""
SELECT Z, A, MT, {", ".join(f"{r(f'any_value(gp_mean) {s} {k} * any_value(gp_std)')} AS log_{side}_{n}, {r(f'pow(10, any_value(gp_mean) {s} {k} * any_value(gp_std))', 4)} AS {side}_{n}"
  for n, k in (("1", 1), ("2", 2), ("t", 3)) for s, side in (("-", "low"), ("+", "high")))} FROM s GROUP BY ALL""", scored=True)
def bands(spark, sf):
    lines = scored(spark, sf).groupBy(*KEYS).agg(F.first("gp_mean").alias("gp_mean"), F.first("gp_std").alias("gp_std"))
    out = outliers.bands(lines).drop("gp_mean", "gp_std")
    logs = [c for c in out.columns if c.startswith("log_")]
    return round_columns(round_columns(out, *logs), *[c for c in out.columns if c not in (*logs, *KEYS)], digits=4)


_FINE = "Z, A, MT, Projectile, Entry"


@register("w14_small_group_policy", f"""
, g AS (SELECT *, log10(CrossSection) AS y FROM q), a AS (SELECT {_FINE}, quantile_cont(y, 0.5) AS c, count(*) AS cnt FROM g GROUP BY ALL),
d AS (SELECT g.*, c, cnt, abs(y - c) AS away FROM g JOIN a USING ({_FINE})),
e AS (SELECT {_FINE}, quantile_cont(away, 0.5) * 1.4826::DOUBLE AS sd FROM d GROUP BY ALL),
f AS (SELECT d.*, CASE WHEN cnt = 1 THEN 1.0::DOUBLE WHEN sd < 1e-10 THEN 1e-6 ELSE sd END AS sigma FROM d JOIN e USING ({_FINE}))
SELECT Z, MT, cnt AS group_size, count(*) AS points, count(*) FILTER (cnt > 1 AND away / sigma > 3) AS far, {r('avg(sigma)')} AS mean_sigma FROM f GROUP BY ALL""")
def small_groups(spark, sf):
    keys = [*FULL_KEYS, "Entry"]
    rows = outliers.prepare(clean(spark, sf), outliers.OutlierConfig())
    out = outliers.score_small_policy(rows, keys, size_as="group_size")
    return out.groupBy("Z", "MT", "group_size").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("z_score") > 3).alias("far"), rounded(F.avg("gp_std")).alias("mean_sigma"))


@register("w15_log_space_uncertainty", f"""
, u AS (SELECT *, CASE WHEN Uncertainty > 0 THEN Uncertainty / CrossSection END AS rel FROM q),
g AS (SELECT Z, A, MT, Projectile, max(rel) AS top FROM u GROUP BY ALL)
SELECT Z, A, MT, Projectile, count(*) AS n, {r('sum(0.434::DOUBLE * least(greatest(coalesce(rel, top), 0.01::DOUBLE), 1.0::DOUBLE))')} AS total FROM u JOIN g USING (Z, A, MT, Projectile) GROUP BY ALL""")
def log_space(spark, sf):
    out = outliers.log_space_uncertainty(clean(spark, sf), FULL_KEYS)
    return out.groupBy(*FULL_KEYS).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("log_uncertainty")).alias("total"))


# -------------------------------------------------------------------- ranking
@register("r01_sorted_by_energy", "SELECT Energy, CrossSection FROM m WHERE Z = 5 AND MT = 18")
def sorted_rows(spark, sf):
    return measurements(spark, sf).filter("Z = 5 AND MT = 18").orderBy("Energy").select("Energy", "CrossSection")


@register("r02_top_k", "SELECT Entry, count(*) AS count FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_k(spark, sf):
    return P.top_counts(measurements(spark, sf), "Entry", 10)


@register("r03_bottom_k", "SELECT Z, A, count(*) AS count FROM m GROUP BY ALL ORDER BY 3, 1, 2 LIMIT 10")
def bottom_k(spark, sf):
    counts = measurements(spark, sf).groupBy("Z", "A").agg(F.count(F.lit(1)).alias("count"))
    return ranking.top_k(counts, "count", 10, ["Z", "A"], largest=False)


@register("r04_best_candidate", """
, c AS (SELECT l_suppkey, l_orderkey AS section_id, l_shipdate, CASE l_returnflag WHEN 'A' THEN 'ENDF' WHEN 'N' THEN 'JEFF' ELSE 'TENDL' END AS library,
  CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END AS sublibrary, l_orderkey * 1000 + l_partkey AS position FROM lineitem WHERE l_discount > 0.09 AND l_suppkey % 3 <> 0),
p AS (SELECT *, CASE WHEN library = 'ENDF' AND sublibrary = 10 THEN 0 WHEN library = 'ENDF' THEN 1 WHEN sublibrary = 10 THEN 2 ELSE 3 END AS priority FROM c)
SELECT l_suppkey, library, sublibrary, priority FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY priority, position) = 1""")
def best_candidate(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_discount > 0.09 AND l_suppkey % 3 <> 0").select(
        "l_suppkey", F.col("l_orderkey").alias("section_id"),
        F.when(F.col("l_returnflag") == "A", "ENDF").when(F.col("l_returnflag") == "N", "JEFF").otherwise("TENDL").alias("library"),
        F.when(F.col("l_linestatus") == "O", 10).otherwise(0).alias("sublibrary"), (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("position"))
    return ranking.best_candidate(rows, ["l_suppkey"], "ENDF").select("l_suppkey", "library", "sublibrary", "priority")


@register("r04b_overlay_curve", f"SELECT Z, count(*) AS n, {r('avg(log10(Energy))')} AS log_e, {r('avg(log10(CrossSection))')} AS log_s FROM m WHERE Energy > 0 AND CrossSection > 0 GROUP BY Z")
def overlay(spark, sf):
    return ranking.overlay_curve(measurements(spark, sf)).groupBy("Z").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("log_E")).alias("log_e"), rounded(F.avg("log_sigma")).alias("log_s"))


@register("r05_nearest_neighbours", f"""
SELECT e.vec_id, {r('sqrt(list_sum(list_transform(list_zip(e.embedding, q0.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))', 5)} AS distance
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q0 WHERE e.vec_id <> 3 ORDER BY distance, e.vec_id LIMIT 10""")
def neighbours(spark, sf):
    return round_columns(ranking.nearest_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 3, 10), "distance", digits=5)


@register("r06_cosine_similarity", f"""
SELECT e.vec_id, {r('list_cosine_similarity(e.embedding::DOUBLE[], q0.embedding::DOUBLE[])', 5)} AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q0""")
def cosine(spark, sf):
    return round_columns(ranking.similarity_to(table(spark, sf, "embeddings"), "vec_id", "embedding", 3), "similarity", digits=5)


@register("r08_subsample_size", "SELECT least(CAST(floor(count(*) * 0.3) AS BIGINT), 5000) AS n FROM m")
def subsample(spark, sf):
    return ranking.subsample(measurements(spark, sf), 0.3, 5000).agg(F.count(F.lit(1)).alias("n"))


@register("r09_sorted_distinct", "SELECT DISTINCT Entry FROM m")
def sorted_distinct(spark, sf):
    return P.sorted_distinct(measurements(spark, sf), "Entry")
