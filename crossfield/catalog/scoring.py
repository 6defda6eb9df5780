"""Queries of the full outlier scoring, with the whole method written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfield.catalog.base import FULL_KEYS, KEYS, clean, r, register, round_columns, rounded, table
from crossfield.catalog.reports import _FIT_WEIGHTS
from crossfield.operators import outliers, outliers_hot
from crossfield.operators.profile import with_logs
from crossfield.plans.ordering import with_tiles
from crossfield.plans.scale import attach, group_sizes, stored
from crossfield.plans.windows import window_medians

_K = "Z, A, MT, Projectile"
_SUMS = ", ".join(f"sum(w * w * pow(t, {p})) AS m{p}" for p in range(7)) + ", " + ", ".join(
    f"sum(w * w * pow(t, {p}) * y) AS b{p}" for p in range(4))
# Cholesky factor and back substitution of the four normal equations, column by column.
_SOLVE = """sqrt(m0) AS a1, m1 / a1 AS a2, m2 / a1 AS a3, m3 / a1 AS a4,
 sqrt(m2 - a2 * a2) AS d2, (m3 - a3 * a2) / d2 AS d3, (m4 - a4 * a2) / d2 AS d4,
 sqrt(m4 - a3 * a3 - d3 * d3) AS e3, (m5 - a4 * a3 - d4 * d3) / e3 AS e4, sqrt(m6 - a4 * a4 - d4 * d4 - e4 * e4) AS f4,
 b0 / a1 AS y1, (b1 - a2 * y1) / d2 AS y2, (b2 - a3 * y1 - d3 * y2) / e3 AS y3, (b3 - a4 * y1 - d4 * y2 - e4 * y3) / f4 AS y4,
 y4 / f4 AS c3, (y3 - e4 * c3) / e3 AS c2, (y2 - d3 * c2 - d4 * c3) / d2 AS c1, (y1 - a2 * c1 - a3 * c2 - a4 * c3) / a1 AS c0"""
_POLY = "((c3 * t + c2) * t + c1) * t + c0"


def _rounds(n: int = 5) -> str:
    parts = [f"""
k0 AS MATERIALIZED (SELECT {_K}, c0, c1, c2, c3, false AS done FROM (SELECT {_K}, {_SOLVE} FROM (SELECT {_K}, {_SUMS} FROM pt GROUP BY ALL)))"""]
    for i in range(1, n + 1):
        parts.append(f"""
r{i} AS MATERIALIZED (SELECT pt.*, c0, c1, c2, c3, y - ({_POLY}) AS res FROM pt JOIN k{i - 1} USING ({_K})),
md{i} AS MATERIALIZED (SELECT {_K}, quantile_cont(res, 0.5) AS med FROM r{i} GROUP BY ALL),
ma{i} AS MATERIALIZED (SELECT {_K}, quantile_cont(abs(res - med), 0.5) AS mad FROM r{i} JOIN md{i} USING ({_K}) GROUP BY ALL),
wr{i} AS MATERIALIZED (SELECT r{i}.* EXCLUDE (w), w * CASE WHEN abs(res) / (mad * 1.4826::DOUBLE) <= 3 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE / (abs(res) / (mad * 1.4826::DOUBLE)) END AS w
  FROM r{i} JOIN ma{i} USING ({_K})),
nw{i} AS MATERIALIZED (SELECT {_K}, {_SOLVE} FROM (SELECT {_K}, {_SUMS} FROM wr{i} GROUP BY ALL)),
sp{i} AS MATERIALIZED (SELECT {_K}, max(abs((((n.c3 * t + n.c2) * t + n.c1) * t + n.c0) - (((q.c3 * t + q.c2) * t + q.c1) * t + q.c0))) AS step
  FROM r{i} q JOIN nw{i} n USING ({_K}) GROUP BY ALL),
k{i} AS MATERIALIZED (SELECT {_K}, CASE WHEN o.done THEN o.c0 ELSE n.c0 END AS c0, CASE WHEN o.done THEN o.c1 ELSE n.c1 END AS c1,
  CASE WHEN o.done THEN o.c2 ELSE n.c2 END AS c2, CASE WHEN o.done THEN o.c3 ELSE n.c3 END AS c3, o.done OR step < 1e-4 AS done
  FROM k{i - 1} o JOIN nw{i} n USING ({_K}) JOIN sp{i} USING ({_K}))""")
    return ",".join(parts)


_FULL = _FIT_WEIGHTS + f""",
gs AS (SELECT {_K}, count(*) AS cnt, count(DISTINCT Entry) AS exps, min(x) AS lo, max(x) AS hi FROM wt GROUP BY ALL),
dd AS (SELECT {_K}, x, avg(y) AS y, avg(coalesce(fit_weight, 1.0::DOUBLE)) AS w FROM wt GROUP BY ALL),
pt AS MATERIALIZED (SELECT dd.*, (2.0::DOUBLE * x - lo - hi) / (hi - lo) AS t FROM dd JOIN gs USING ({_K}) WHERE cnt >= 10),
{_rounds()},
tr AS MATERIALIZED (SELECT {_K}, Entry, x, y, cnt, greatest((hi - lo) * 0.1::DOUBLE, 0.1::DOUBLE) AS half, (2.0::DOUBLE * x - lo - hi) / (hi - lo) AS t, {_POLY} AS mu, y - mu AS res
  FROM wt JOIN gs USING ({_K}) JOIN k5 USING ({_K})),
wi AS (SELECT *, list(res) OVER (PARTITION BY {_K} ORDER BY x RANGE BETWEEN half PRECEDING AND half FOLLOWING) AS near,
  list({{'x': x, 'r': res}}) OVER (PARTITION BY {_K} ORDER BY x, res ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING) AS around FROM tr),
wl AS (SELECT * EXCLUDE (near, around), CASE WHEN len(near) >= 15 THEN near ELSE
  list_transform(list_sort(list_transform(around, lambda p: {{'d': abs(p.x - x), 'x': p.x, 'r': p.r}}))[1:15], lambda p: p.r) END AS l FROM wi),
wm AS (SELECT * EXCLUDE (l), list_aggregate(l, 'median') AS lm, greatest(list_aggregate(list_transform(l, lambda v: abs(v - lm)), 'median') * 1.4826::DOUBLE, 0.02::DOUBLE) AS mad FROM wl),
fs AS (SELECT *, (CASE WHEN greatest(5, cnt // 20) % 2 = 0 THEN greatest(5, cnt // 20) + 1 ELSE greatest(5, cnt // 20) END) // 2 AS hw,
  row_number() OVER g AS pos, first_value(mad) OVER (PARTITION BY {_K} ORDER BY x, res ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head,
  last_value(mad) OVER (PARTITION BY {_K} ORDER BY x, res ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM wm WINDOW g AS (PARTITION BY {_K} ORDER BY x, res)),
fl AS (SELECT *, list(mad) OVER (PARTITION BY {_K} ORDER BY x, res ROWS BETWEEN hw PRECEDING AND hw FOLLOWING) AS fw FROM fs),
sm AS (SELECT *, greatest(list_aggregate(list_concat(fw, list_transform(range(greatest(hw + 1 - pos, 0)), lambda i: head), list_transform(range(greatest(pos + hw - cnt, 0)), lambda i: tail)), 'median'), 0.02::DOUBLE) AS sg FROM fl),
sx AS (SELECT *, avg(sg) OVER (PARTITION BY {_K}, x) AS sigma FROM sm),
big AS (SELECT {_K}, Entry, mu, sigma, abs(res) / sigma AS dist FROM sx),
sc AS (SELECT {_K}, quantile_cont(y, 0.5) AS c FROM wt JOIN gs USING ({_K}) WHERE cnt < 10 GROUP BY ALL),
sd AS (SELECT {_K}, quantile_cont(abs(y - c), 0.5) * 1.4826::DOUBLE AS sd FROM wt JOIN sc USING ({_K}) GROUP BY ALL),
sml AS (SELECT {_K}, Entry, c AS mu, CASE WHEN sd < 1e-10 THEN 1e-6 ELSE sd END AS sigma, abs(y - c) / CASE WHEN sd < 1e-10 THEN 1e-6 ELSE sd END AS dist
  FROM wt JOIN sc USING ({_K}) JOIN sd USING ({_K})),
al AS (SELECT * FROM big UNION ALL SELECT * FROM sml),
ex AS (SELECT {_K}, Entry, avg((dist > 3)::INT) AS bad FROM al GROUP BY ALL),
fin AS (SELECT al.*, dist > 3 AS point_outlier, bad > 0.3 AND exps > 1 AND cnt >= 10 AS experiment_outlier FROM al JOIN ex USING ({_K}, Entry) JOIN gs USING ({_K}))
"""


@register("w01_outlier_scores", _FULL + f"""
SELECT {_K}, count(*) AS n, count(*) FILTER (point_outlier) AS n_outliers, count(*) FILTER (experiment_outlier) AS n_discrepant, {r('avg(dist)', 5)} AS mean_z FROM fin GROUP BY ALL""")
def outlier_scores(spark, sf):
    out = outliers.score(clean(spark, sf)).groupBy(*FULL_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("point_outlier").alias("n_outliers"), F.count_if("experiment_outlier").alias("n_discrepant"), F.avg("z_score").alias("mean_z"))
    return round_columns(out, "mean_z", digits=5)


# Every row's scores. Groups above the limit take another plan to the same numbers (tests/test_outliers.py).
# Spark can neither store nor select Z beside z; z_1 is what DuckDB calls the second one in a table or data frame.
@register("w01_row_scores", _FULL + f"""
SELECT {_K}, Entry, {r('mu', 4)} AS mean, {r('sigma', 4)} AS sigma, {r('dist', 4)} AS z, point_outlier, experiment_outlier FROM fin""")
def row_scores(spark, sf):
    return outliers.score(clean(spark, sf)).select(
        *FULL_KEYS, "Entry", rounded("gp_mean", 4).alias("mean"), rounded("gp_std", 4).alias("sigma"), rounded("z_score", 4).alias("z_1"),
        "point_outlier", "experiment_outlier")


# Sliding windows of 601 rows in groups of thousands, in tiles of at most 1,000 rows.
@register("w08_long_windows", f"""
, o AS (SELECT l_linenumber AS line, l_orderkey AS id, l_discount * l_extendedprice AS v FROM lineitem)
SELECT line, id, {r('median(v) OVER w', 4)} AS middle, {r('mad(v) OVER w', 4)} AS mad FROM o
WINDOW w AS (PARTITION BY line ORDER BY id, v ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING)""")
def long_windows(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("id"), (F.col("l_discount") * F.col("l_extendedprice")).alias("v"))
    ranked = with_tiles(rows, ["line"], ["id", "v"], 1000, rank_as="rank").drop("__tile")
    last = group_sizes(ranked, ["line"]).table.withColumnRenamed("group_rows", "n")
    ranked = stored(attach(ranked, last, ["line"]))
    windows = ranked.select("line", "rank", "v", F.greatest(F.col("rank") - 300, F.lit(0)).alias("s"), F.least(F.col("rank") + 301, F.col("n")).alias("e"))
    found = window_medians(windows, ["line"], 1000, spread=True)
    return attach(ranked.select("line", "id", "rank"), found, ["line", "rank"]).select(
        "line", "id", rounded("median", 4).alias("middle"), rounded("mad", 4).alias("mad"))


@register("w05_duplicate_averages", f"""
, u AS (SELECT {_K}, log10(Energy) AS x, avg(log10(CrossSection)) AS y, count(*) AS m FROM q GROUP BY ALL)
SELECT {_K}, count(*) AS n_x, max(m) AS most, {r('avg(y)')} AS y FROM u GROUP BY ALL""")
def duplicate_averages(spark, sf):
    unique = with_logs(clean(spark, sf)).groupBy(*FULL_KEYS, "log_E").agg(F.avg("log_sigma").alias("y"), F.count(F.lit(1)).alias("m"))
    return unique.groupBy(*FULL_KEYS).agg(F.count(F.lit(1)).alias("n_x"), F.max("m").alias("most"), rounded(F.avg("y")).alias("y"))


@register("w06_smooth_mean", _FULL + f" SELECT {_K}, {r('avg(mu)', 5)} AS mean, {r('min(mu)', 5)} AS low, {r('max(mu)', 5)} AS high FROM fin GROUP BY ALL")
def smooth_mean(spark, sf):
    out = outliers.score(clean(spark, sf)).groupBy(*FULL_KEYS).agg(F.avg("gp_mean").alias("mean"), F.min("gp_mean").alias("low"), F.max("gp_mean").alias("high"))
    return round_columns(out, "mean", "low", "high", digits=5)


@register("w06_trend_criterion", _FIT_WEIGHTS + f""",
gs AS (SELECT {_K}, count(*) AS cnt, min(x) AS lo, max(x) AS hi FROM wt GROUP BY ALL),
dd AS (SELECT {_K}, x, avg(y) AS y, avg(coalesce(fit_weight, 1.0::DOUBLE)) AS w FROM wt GROUP BY ALL),
pt AS MATERIALIZED (SELECT dd.*, cnt, (2.0::DOUBLE * x - lo - hi) / (hi - lo) AS t FROM dd JOIN gs USING ({_K}) WHERE cnt >= 10),
{_rounds(0).strip()},
cr AS (SELECT {_K}, count(*) AS n_x, sum(w) AS sw, var_pop(y) AS v, sum(pow(w * (y - ({_POLY})), 2)) AS q FROM pt JOIN k0 USING ({_K}) GROUP BY ALL)
SELECT {_K}, n_x, {r('log10(q * n_x * n_x / (sw * sw))', 5)} AS criterion, {r('log10(n_x * greatest(v, 1e-6))', 5)} AS allowed, q * n_x * n_x / (sw * sw) <= n_x * greatest(v, 1e-6) AS cubic_enough FROM cr""")
def trend_criterion(spark, sf):
    found = outliers_hot.trend_criterion(clean(spark, sf)).filter("n_rows >= 10")
    return found.select(*FULL_KEYS, "n_x", rounded(F.log10("criterion"), 5).alias("criterion"), rounded(F.log10("allowed"), 5).alias("allowed"), "cubic_enough")


@register("w08_local_sigma", _FULL + f" SELECT {_K}, {r('avg(sigma)', 5)} AS mean, {r('min(sigma)', 5)} AS low, {r('max(sigma)', 5)} AS high FROM fin GROUP BY ALL")
def local_sigma(spark, sf):
    # Only what the scores are made of is moved to the tasks that score whole groups.
    rows = clean(spark, sf).select(*FULL_KEYS, "Entry", "Energy", "CrossSection", "Uncertainty")
    out = outliers.score(rows).groupBy(*FULL_KEYS).agg(F.avg("gp_std").alias("mean"), F.min("gp_std").alias("low"), F.max("gp_std").alias("high"))
    return round_columns(out, "mean", "low", "high", digits=5)


# A linear trend and sigma, so that interpolating them gives the line itself.
@register("w11_probability_surface", f"""
, g AS (SELECT {KEYS[0]}, MT, min(log10(Energy)) AS lo, max(log10(Energy)) AS hi, min(log10(CrossSection)) - 1 AS smin, max(log10(CrossSection)) + 1 AS smax, count(DISTINCT log10(Energy)) AS nx FROM q GROUP BY Z, MT),
c AS (SELECT Z, MT, i, j, lo + i * ((hi - lo) / 19) AS x, smin + j * (smax - smin) / 19 AS y FROM g, range(20) a(i), range(20) b(j) WHERE nx >= 2),
d AS (SELECT *, (y - (0.5::DOUBLE * x - 2)) / (0.2::DOUBLE + 0.05::DOUBLE * x) AS u, 0.2::DOUBLE + 0.05::DOUBLE * x AS sd FROM c)
SELECT Z, MT, j, count(*) AS n, {r('avg(exp(-0.5::DOUBLE * u * u) / (sd * sqrt(2 * pi())))')} AS density, {r('avg(y)')} AS y FROM d GROUP BY ALL""")
def surface(spark, sf):
    rows = with_logs(clean(spark, sf)).withColumns({"gp_mean": F.col("log_E") * 0.5 - 2, "gp_std": F.col("log_E") * 0.05 + 0.2})
    cells = outliers.probability_surface(rows, ["Z", "MT"], grid=20)
    return cells.groupBy("Z", "MT", "j").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("density")).alias("density"), rounded(F.avg("y")).alias("y"))
