"""Queries of reference joins, features, transforms, weights, metrics, graphs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.catalog.base import (
    FULL_KEYS, KEYS, REFERENCE, clean, measurements, r, reference, register, round_columns, rounded, scored, table,
)
from crossfield.catalog.rows import _FLAG_SQL, _PARTICLE_SQL, _SEMF, _nearest
from crossfield.functions import scalars as S
from crossfield.operators import classify, evaluate as E, features, graph, models, outliers
from crossfield.operators import reference as R
from crossfield.operators.select import Holdout
from crossfield.operators.transform import Scaler, TransformConfig, scaler_statistics
from crossfield.operators.weights import add_sample_weights
from crossfield.plans.scale import new_folder, stored
from crossfield.sources import points

# ---------------------------------------------------------------------- joins
_STATUS = "s_acctbal < 2000"


@register("j01_metadata_points", """
SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def metadata_points(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    heads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    # Rows are combined per order first, so that distinct orders need no set per priority.
    per = points.join_datasets(heads, lines, "id").groupBy("priority", "id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("priority").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("orders"))


@register("j02_points_with_codes", "SELECT l_suppkey % 4 = 0 AS coded, count(*) AS n FROM lineitem GROUP BY 1")
def points_with_codes(spark, sf):
    codes = table(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select(
        F.col("s_suppkey").alias("DatasetID"), F.lit("CUM").alias("sf5"), F.lit("SIG").alias("sf6"),
        F.lit(None).cast("string").alias("sf8"), F.lit("EXP").alias("sf9"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("DatasetID"))
    joined = classify.join_metadata(rows, codes.unionByName(codes))
    return joined.groupBy(F.col("sf6").isNotNull().alias("coded")).agg(F.count(F.lit(1)).alias("n"))


@register("j03_superseded_removal", f"""
SELECT Entry, count(*) AS n FROM m WHERE substr(Entry, 1, 8) NOT IN (SELECT CAST(s_suppkey AS STRING) FROM supplier WHERE {_STATUS}) GROUP BY Entry""")
def superseded(spark, sf):
    status = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("SubentID"), F.when(F.expr(_STATUS), F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("D")).otherwise("0").alias("SPSDD"))
    return classify.drop_superseded(measurements(spark, sf), status, "Entry").groupBy("Entry").agg(F.count(F.lit(1)).alias("n"))


def _reference_parts(spark, sf):
    ref = reference(spark, sf)
    masses = ref.select("Z", "A", "N", *R.MASS_COLUMNS)
    first = ref.filter("A % 2 = 0").select("Z", "A", "S_2n_keV", "S_2p_keV")
    second = ref.filter("A % 3 = 0").select("Z", "A", "S_1n_keV", "S_1p_keV")
    state = measurements(spark, sf).select("Z", "A").distinct().filter("A % 5 <> 0").select(
        "Z", "A", (F.col("A") / 2.0).alias("Spin"), F.lit(1).alias("Parity"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("Isomer_Level")).withColumn("Half_Life_s", F.col("A") * 10.0 + F.col("Isomer_Level"))
    return masses, first, second, state


_STRUCT = ", st AS (SELECT DISTINCT Z, A, A / 2.0 AS sp, l, A * 10.0::DOUBLE + l AS h FROM m, (VALUES (0), (1)) v(l) WHERE A % 5 <> 0)"
_BASE = """, b AS (SELECT ref.Z, ref.A, Mass_Excess_keV, CASE WHEN ref.A % 2 = 0 THEN S_2n_keV END AS S_2n_keV, CASE WHEN ref.A % 3 = 0 THEN S_1n_keV END AS S_1n_keV FROM ref)"""


@register("j04_reference_build", _STRUCT + _BASE + """
SELECT b.Z, b.A, Mass_Excess_keV, S_2n_keV, S_1n_keV, sp AS Spin, l AS Isomer_Level, h AS Half_Life_s
FROM b LEFT JOIN st ON st.Z = b.Z AND st.A = b.A AND l = 0
UNION ALL SELECT b.Z, b.A, Mass_Excess_keV, S_2n_keV, S_1n_keV, sp, l, h FROM b JOIN st ON st.Z = b.Z AND st.A = b.A AND l = 1""", reference=True)
def reference_build(spark, sf):
    return R.build_reference(*_reference_parts(spark, sf)).select(
        "Z", "A", "Mass_Excess_keV", "S_2n_keV", "S_1n_keV", "Spin", "Isomer_Level", "Half_Life_s")


@register("j05_isomer_rows", _STRUCT + """
SELECT ref.Z, ref.A, Mass_Excess_keV, sp AS Spin, l AS Isomer_Level, h AS Half_Life_s FROM ref JOIN st ON st.Z = ref.Z AND st.A = ref.A AND l = 1""", reference=True)
def isomers(spark, sf):
    masses, first, second, state = _reference_parts(spark, sf)
    return R.build_reference(masses, structure=state).filter("Isomer_Level > 0").select(
        "Z", "A", "Mass_Excess_keV", "Spin", "Isomer_Level", "Half_Life_s")


@register("j06_enrichment", f"""
SELECT count(*) AS n, count(Mass_Excess_keV) AS found, {r('avg(Mass_Excess_keV)')} AS mass, {r('100.0::DOUBLE * count(Mass_Excess_keV) / count(*)')} AS Mass_Excess_keV_pct
FROM m LEFT JOIN ref USING (Z, A)""", reference=True)
def enrichment(spark, sf):
    rows = R.enrich(measurements(spark, sf), reference(spark, sf), ["A", "C"])
    share = R.coverage(rows, ["Mass_Excess_keV"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("Mass_Excess_keV").alias("found"), rounded(F.avg("Mass_Excess_keV")).alias("mass")).crossJoin(
        round_columns(share, "Mass_Excess_keV_pct"))


@register("j07_tier_enrichment", "SELECT MT, count(*) AS n, sum(Spin_ref) AS spins FROM m LEFT JOIN (SELECT Z, A, Spin AS Spin_ref FROM ref) USING (Z, A) GROUP BY MT", reference=True)
def tier_enrichment(spark, sf):
    rows = R.enrich(measurements(spark, sf).withColumn("Spin", F.lit(-1.0)), reference(spark, sf), ["D"])
    return rows.groupBy("MT").agg(F.count(F.lit(1)).alias("n"), F.sum("Spin_ref").alias("spins"))


@register("j08_nuclide_lookup", "SELECT Z, A, N, Spin, Parity, Isomer_Level, Half_Life_s FROM ref WHERE Z = 3 AND A = 8", reference=True)
def lookup(spark, sf):
    return R.lookup(reference(spark, sf), 3, 8, ["D"])




@register("s16_formula_fallback", f"""
, n AS (SELECT DISTINCT Z, A FROM q)
SELECT n.Z, n.A, {r(f'coalesce(ref.Mass_Excess_keV, (SELECT -({_SEMF})*1000 FROM (SELECT n.Z AS Z, n.A AS A)))', 3)} AS Mass_Excess_keV FROM n LEFT JOIN ref ON ref.Z = n.Z AND ref.A = n.A""", reference=True)
def formula_fallback(spark, sf):
    rows = R.enrich(clean(spark, sf).select("Z", "A").distinct(), reference(spark, sf).select("Z", "A", *R.MASS_COLUMNS[:2]))
    return round_columns(R.fill_missing_masses(rows).select("Z", "A", "Mass_Excess_keV"), "Mass_Excess_keV", digits=3)


@register("j13_scored_rows_only", "SELECT Z, count(*) AS n FROM s WHERE gp_mean IS NOT NULL GROUP BY Z", scored=True)
def scored_only(spark, sf):
    return scored(spark, sf).filter("z_score IS NOT NULL").groupBy("Z").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- features
_MEV = [c for t in "CE" for c in R.TIER_COLUMNS[t]]
_TIERS = f"""
, f AS (SELECT q.*, q.A - q.Z AS nn, ref.* EXCLUDE (Z, A, N), {_nearest('(q.A - q.Z)')} AS Shell_Closure_N, {_nearest('q.Z')} AS Shell_Closure_P FROM q LEFT JOIN ref USING (Z, A)),
g AS (SELECT *, abs(nn - Shell_Closure_N) AS Valence_N, abs(Z - Shell_Closure_P) AS Valence_P, {_PARTICLE_SQL.replace('mt BETWEEN', 'MT BETWEEN')} FROM f)"""


@register("t06_tier_features", _TIERS + f"""
SELECT Z, A, MT, count(*) AS n, {r('avg(kr)')} AS kr, CAST(sum(out_n) AS BIGINT) AS out_n, {r('sum(CASE WHEN Valence_N + Valence_P = 0 THEN 0 ELSE Valence_N * Valence_P / (Valence_N + Valence_P)::DOUBLE END)', 4)} AS p_factor,
  {r('any_value(Mass_Excess_keV / 1000)')} AS mass, {r('any_value(Q_alpha_keV / 1000)')} AS q_alpha, {r('any_value(log10(greatest(CASE WHEN isinf(Half_Life_s) THEN 1e30 ELSE Half_Life_s END, 1e-30)))')} AS half_life
FROM (SELECT *, 0.22 * sqrt(Energy / 1e6) * 1.25 * pow(A, 1.0/3.0) AS kr FROM g) GROUP BY ALL""", reference=True)
def tier_features(spark, sf):
    rows = features.tabular(clean(spark, sf), reference(spark, sf), list("ABCDE"))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("kR")).alias("kr"), F.sum("out_n").cast("long").alias("out_n"), rounded(F.sum("P_Factor"), 4).alias("p_factor"),
        rounded(F.first("Mass_Excess_MeV")).alias("mass"), rounded(F.first("Q_alpha_MeV")).alias("q_alpha"), rounded(F.first("Half_Life_log10_s")).alias("half_life"))


@register("c03_kev_to_mev", f"SELECT MT, {', '.join(f'{r(f'avg({c}) / 1000', 4)} AS {c.removesuffix('_keV')}' for c in _MEV)} FROM q LEFT JOIN ref USING (Z, A) GROUP BY MT", reference=True)
def kev_to_mev(spark, sf):
    rows = R.enrich(clean(spark, sf), reference(spark, sf), ["C", "E"])
    out = features.add_reaction_energies(features.add_energetics(rows))
    return out.groupBy("MT").agg(*[rounded(F.avg(c.removesuffix("_keV") + "_MeV"), 4).alias(c.removesuffix("_keV")) for c in _MEV])


@register("t08_reaction_subset", _TIERS + """
SELECT Z, MT, count(*) AS n, CAST(sum(out_g) AS BIGINT) AS out_g, CAST(sum(out_f) AS BIGINT) AS out_f FROM g WHERE MT IN (18, 102) GROUP BY ALL""", reference=True)
def reaction_subset(spark, sf):
    rows = features.tabular(clean(spark, sf), reference(spark, sf), ["A", "D"], reactions=[18, 102])
    return rows.groupBy("Z", "MT").agg(F.count(F.lit(1)).alias("n"), F.sum("out_g").alias("out_g"), F.sum("out_f").alias("out_f"))


@register("f24_projected_holdout", _TIERS + """
SELECT A, count(*) AS n, CAST(sum(out_n) AS BIGINT) AS out_n, CAST(sum(Valence_N) AS BIGINT) AS valence FROM g WHERE Z = 2 AND MT = 16 GROUP BY A""", reference=True)
def projected_holdout(spark, sf):
    _, held = Holdout([{"Z": 2, "MT": 16}]).split(clean(spark, sf))
    rows = features.tabular(held, reference(spark, sf), ["A", "D"])
    return rows.groupBy("A").agg(F.count(F.lit(1)).alias("n"), F.sum("out_n").cast("long").alias("out_n"), F.sum("Valence_N").alias("valence"))


# ------------------------------------------------------------------ transforms
_SCALED = ["Energy", "CrossSection", "Uncertainty"]


def _state_sql(shift, scale):
    parts = ", ".join(f"{r(shift.format(c=c))} AS {c}__shift, {r(scale.format(c=c))} AS {c}__scale" for c in _SCALED)
    return f"SELECT {parts} FROM (SELECT log10(Energy) AS Energy, CrossSection, Uncertainty FROM q)"


def _state(scaler):
    def run(spark, sf):
        rows = clean(spark, sf).withColumn("Energy", F.log10("Energy"))
        out = scaler_statistics(rows, _SCALED, scaler)
        return round_columns(out, *out.columns)
    return run


register("t01_scaler_standard", _state_sql("avg({c})", "stddev_pop({c})"))(_state("standard"))
register("t01_scaler_minmax", _state_sql("min({c})", "max({c}) - min({c})"))(_state("minmax"))
register("t01_scaler_robust", _state_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))(_state("robust"))


@register("t02_scaled_features", f"""
, e AS (SELECT Z, log10(Energy) AS e, CrossSection AS x, Uncertainty AS u FROM q)
SELECT Z, count(*) AS n, {r('avg((e - e0) / (e1 - e0))')} AS energy, {r('avg((x - x0) / (x1 - x0))')} AS xs, {r('avg((u - u0) / (u1 - u0))')} AS unc
FROM e, (SELECT min(e) AS e0, max(e) AS e1, min(x) AS x0, max(x) AS x1, min(u) AS u0, max(u) AS u1 FROM e) GROUP BY Z""")
def scaled_features(spark, sf):
    rows = clean(spark, sf)
    out = Scaler().fit_transform(rows, _SCALED)
    return out.groupBy("Z").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("Energy")).alias("energy"), rounded(F.avg("CrossSection")).alias("xs"), rounded(F.avg("Uncertainty")).alias("unc"))


@register("k05_scaler_state", f"""
, e AS (SELECT Z, log10(Energy) AS e, CrossSection AS x, Uncertainty AS u FROM q)
SELECT Z, count(*) AS n, {r('avg((e - e0) / (e1 - e0))')} AS energy, {r('avg((x - x0) / (x1 - x0))')} AS xs, {r('avg((u - u0) / (u1 - u0))')} AS unc
FROM e, (SELECT min(e) AS e0, max(e) AS e1, min(x) AS x0, max(x) AS x1, min(u) AS u0, max(u) AS u1 FROM e) GROUP BY Z""")
def scaler_state(spark, sf):
    rows, path = clean(spark, sf), new_folder(spark, "scaler")
    Scaler().fit(rows, _SCALED).save(spark, path)
    out = Scaler.load(spark, path).transform(rows)
    return out.groupBy("Z").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("Energy")).alias("energy"), rounded(F.avg("CrossSection")).alias("xs"), rounded(F.avg("Uncertainty")).alias("unc"))


@register("t03_inverse_transform", f"SELECT Z, {r('avg(Energy)', 2)} AS energy, {r('avg(CrossSection)')} AS xs FROM q GROUP BY Z")
def inverse_transform(spark, sf):
    rows = clean(spark, sf)
    scaler = Scaler(TransformConfig(scaler="standard")).fit(rows, _SCALED)
    back = scaler.inverse(scaler.transform(rows))
    return back.groupBy("Z").agg(rounded(F.avg("Energy"), 2).alias("energy"), rounded(F.avg("CrossSection")).alias("xs"))


_WEIGHTS = """
, w AS (SELECT Z, MT, CASE WHEN Uncertainty > 0 THEN 1.0::DOUBLE / pow(Uncertainty / (CrossSection * ln(10.0)), 2) END AS a,
              CASE WHEN Energy_Uncertainty > 0 THEN 1.0::DOUBLE / pow(Energy_Uncertainty / (Energy * ln(10.0)), 2) END AS b FROM q),
v AS (SELECT Z, MT, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM w)){both} AS w FROM w),
c AS (SELECT Z, MT, least(w, (SELECT quantile_cont(w, 0.99) FROM v)) AS w FROM v)
SELECT Z, MT, count(*) AS n, {low} AS low, {mean} AS mean, {high} AS high FROM (SELECT Z, MT, w / (SELECT avg(w) FROM c) AS w FROM c) GROUP BY ALL"""


def _weight_query(mode):
    def run(spark, sf):
        out = add_sample_weights(clean(spark, sf), mode, log_target=True, log_energy=True)
        return round_columns(out.groupBy("Z", "MT").agg(
            F.count(F.lit(1)).alias("n"), F.min("weight").alias("low"), F.avg("weight").alias("mean"), F.max("weight").alias("high")), "low", "mean", "high")
    return run


for _mode, _both in (("xs", ""), ("both", " * coalesce(b, (SELECT quantile_cont(b, 0.5) FROM w))")):
    register(f"t10_sample_weights_{_mode}", _WEIGHTS.format(both=_both, low=r("min(w)"), mean=r("avg(w)"), high=r("max(w)")))(_weight_query(_mode))


# --------------------------------------------------------------------- metrics
# A deterministic prediction: the cross section bent by the row's own keys.
_PRED = "CrossSection * (1 + (Z - 4) * 0.05E0) + 0.01E0 * MT"
_PRED_SQL = f", p AS (SELECT *, {_PRED} AS pred FROM q)"


def predicted(spark, sf):
    return clean(spark, sf).withColumn("pred", F.expr(_PRED))


def _metric_sql(t, p, source, suffix=""):
    return (f"{r(f'avg(({p} - {t}) * ({p} - {t}))')} AS mse{suffix}, {r(f'avg(abs({p} - {t}))')} AS mae{suffix}, "
            f"{r(f'1 - sum(({p} - {t}) * ({p} - {t})) / (var_pop({t}) * count({t}))')} AS r2{suffix}")


@register("a37_regression_metrics", _PRED_SQL + f" SELECT {_metric_sql('log10(CrossSection + 1e-10)', 'log10(pred + 1e-10)', 'p')} FROM p")
def regression(spark, sf):
    return round_columns(E.regression_metrics(predicted(spark, sf), "CrossSection", "pred", log_space=True), "mse", "mae", "r2")


@register("a38_holdout_metrics", _PRED_SQL + f"""
, h AS (SELECT *, log10(CrossSection + 1e-10) AS tl, log10(pred + 1e-10) AS pl FROM p WHERE Z = 3)
SELECT count(*) AS holdout_n, {_metric_sql('tl', 'pl', 'h', '_log').replace('AS ', 'AS holdout_').replace('AS holdout_DOUBLE', 'AS DOUBLE')},
  {_metric_sql('CrossSection', 'pred', 'h', '_barns').replace('AS ', 'AS holdout_').replace('AS holdout_DOUBLE', 'AS DOUBLE')}, {r('quantile_cont(abs(pred - CrossSection), 0.5)')} AS holdout_medae_barns FROM h""")
def holdout_metrics(spark, sf):
    rows = predicted(spark, sf).filter("Z = 3").withColumns({"tl": S.log_target("CrossSection"), "pl": S.log_target("pred")})
    out = E.holdout_metrics(rows, "CrossSection", "pred", "tl", "pl")
    return round_columns(out, *[c for c in out.columns if c != "holdout_n"])


@register("a39_generalisation_gap", _PRED_SQL + f"""
, g AS (SELECT MT = 18 AS test, avg((pred - CrossSection) * (pred - CrossSection)) AS mse,
   1 - sum((pred - CrossSection) * (pred - CrossSection)) / (var_pop(CrossSection) * count(*)) AS r2 FROM p GROUP BY 1)
SELECT {r('(b.mse - a.mse) / abs(a.mse) * 100', 4)} AS gap_pct, {r('b.r2 - a.r2')} AS r2_gap,
  CASE WHEN (b.mse - a.mse) / abs(a.mse) * 100 > 50 THEN 'overfitting' WHEN (b.mse - a.mse) / abs(a.mse) * 100 < 2 THEN 'underfitting' ELSE 'normal' END AS verdict
FROM g a, g b WHERE NOT a.test AND b.test""")
def gap(spark, sf):
    rows = predicted(spark, sf)
    parts = [E.regression_metrics(rows.filter(c), "CrossSection", "pred") for c in ("MT <> 18", "MT = 18")]
    return round_columns(round_columns(E.generalisation_gap(*parts), "gap_pct", digits=4), "r2_gap")


# Sensitivities for the nuclides of the view, by a rule on the key.
_SENS_SQL = ", se AS (SELECT DISTINCT Z, A, MT, (Z * 7 + A * 3 + MT) % 23 / 40.0::DOUBLE - 0.25::DOUBLE AS sensitivity FROM q WHERE (Z + A) % 3 <> 0)"


def sensitivities(spark, sf):
    keys = clean(spark, sf).filter("(Z + A) % 3 <> 0").select(*KEYS).distinct()
    return keys.withColumn("sensitivity", F.expr("(Z * 7 + A * 3 + MT) % 23 / 40.0D - 0.25D"))


_IMPACT_SQL = "CASE " + " ".join(f"WHEN abs(sensitivity) > {v} THEN '{n}'" for n, v in K.IMPACT_BANDS) + " ELSE 'NEGLIGIBLE' END"


@register("a40_propagated_uncertainty", _SENS_SQL + f"""
, u AS (SELECT Z, A, MT, 100 * avg(Uncertainty / CrossSection) AS u FROM q GROUP BY ALL)
SELECT {r('sqrt(sum(pow(coalesce(sensitivity, 0) * u / 100, 2))) * 100')} AS k_uncertainty_pct FROM u LEFT JOIN se USING (Z, A, MT)""")
def propagated(spark, sf):
    u = clean(spark, sf).groupBy(*KEYS).agg((100 * F.avg(F.col("Uncertainty") / F.col("CrossSection"))).alias("uncertainty_pct"))
    return round_columns(E.propagated_uncertainty(u, sensitivities(spark, sf)), "k_uncertainty_pct")


@register("a41_top_sensitivities", _SENS_SQL + f" SELECT Z, A, MT, {r('sensitivity')} AS sensitivity, {_IMPACT_SQL} AS impact FROM se ORDER BY abs(se.sensitivity) DESC, Z, A, MT LIMIT 12")
def top_sensitivities(spark, sf):
    return round_columns(E.top_sensitivities(sensitivities(spark, sf), 12), "sensitivity")


@register("a45_impact_bands", _SENS_SQL + f" SELECT {_IMPACT_SQL} AS impact, count(*) AS n FROM se GROUP BY 1")
def impact(spark, sf):
    return sensitivities(spark, sf).groupBy(E.impact_band("sensitivity").alias("impact")).agg(F.count(F.lit(1)).alias("n"))


@register("j11_sensitivity_weights", _SENS_SQL + f"""
, w AS (SELECT Z, MT, coalesce(abs(sensitivity), 0) AS w FROM q LEFT JOIN se USING (Z, A, MT))
SELECT Z, MT, count(*) AS n, {r('avg(w / (SELECT max(w) FROM w))')} AS weight FROM w GROUP BY ALL""")
def sensitivity_weights(spark, sf):
    out = E.add_sensitivity_weights(clean(spark, sf), sensitivities(spark, sf))
    return out.groupBy("Z", "MT").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("weight")).alias("weight"))


@register("j12_mean_key_mse", _PRED_SQL + f"""
, t AS (SELECT Z, A, MT, avg(CrossSection) AS ref FROM q WHERE Z <> 5 GROUP BY ALL)
SELECT {r('avg(mse)')} AS geometric_mse FROM (SELECT avg(pow(pred - ref, 2)) AS mse FROM p JOIN t USING (Z, A, MT) GROUP BY Z, A, MT)""")
def key_mse(spark, sf):
    rows = predicted(spark, sf)
    ref = rows.filter("Z <> 5").groupBy(*KEYS).agg(F.avg("CrossSection").alias("truth"))
    return round_columns(E.mean_key_mse(rows, ref, KEYS, "pred", "truth"), "geometric_mse")


_BENCH = ", ".join(f"({i}, '{n}', {k}::DOUBLE, {s}::DOUBLE)" for i, (n, k, s) in enumerate(K.CRITICALITY_BENCHMARKS))


def predictions_of_k(spark, sf):
    names = F.array(*[F.lit(n) for n, _, _ in K.CRITICALITY_BENCHMARKS])
    return table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(names, (F.col("o_custkey") % 4 + 1).cast("int")).alias("benchmark"),
        F.expr("1 + o_totalprice / 2000000D").alias("k_predicted"), F.expr("0.0001D * (o_custkey % 7)").alias("sigma_predicted"))


@register("j14_benchmark_validation", f"""
, o AS (SELECT o_orderkey, o_custkey % 4 AS i, 1 + o_totalprice / 2000000::DOUBLE AS k, 0.0001::DOUBLE * (o_custkey % 7) AS sp FROM orders)
SELECT o_orderkey, name AS benchmark, {r('k - ref')} AS error, {r('(k - ref) * 1e5 / ref', 3)} AS error_pcm, {r('sqrt(s * s + sp * sp)', 8)} AS uncertainty,
       {r('abs(k - ref) / sqrt(s * s + sp * sp)', 3)} AS sigma, abs((k - ref) * 1e5 / ref) < 300 AS passed FROM o JOIN (VALUES {_BENCH}) b(j, name, ref, s) ON i = j""")
def benchmark_validation(spark, sf):
    out = E.benchmark_validation(predictions_of_k(spark, sf), E.benchmark_table(spark))
    out = out.select("o_orderkey", "benchmark", "error", "error_pcm", "uncertainty", "sigma", "passed")
    return round_columns(round_columns(round_columns(out, "error"), "error_pcm", "sigma", digits=3), "uncertainty", digits=8)


@register("j15_reactivity_error", f"""
, o AS (SELECT 1 + o_totalprice / 2000000::DOUBLE AS k FROM orders), e AS (SELECT ((k - 1) / k - (1.18647::DOUBLE - 1) / 1.18647::DOUBLE) * 1e5 AS e FROM o)
SELECT CASE WHEN abs(e) < 100 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n, {r('avg(e)', 4)} AS mean FROM e GROUP BY 1""")
def reactivity(spark, sf):
    e = predictions_of_k(spark, sf).withColumn("e", E.reactivity_error("k_predicted", F.lit(1.18647)))
    return e.groupBy(E.reactivity_status("e").alias("status")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("e"), 4).alias("mean"))


# ---------------------------------------------------------------------- losses
@register("m10_losses", _PRED_SQL + f"""
SELECT 'mse' AS kind, {r('avg(pow(pred - CrossSection, 2))')} AS loss FROM p
UNION ALL SELECT 'chi2', {r('avg(pow(pred - CrossSection, 2) / greatest(Uncertainty * Uncertainty, 1e-12))', 3)} FROM p WHERE Uncertainty > 0
UNION ALL SELECT 'chi2_incomplete', {r('avg(pow(pred - CrossSection, 2))')} FROM p""")
def losses(spark, sf):
    rows = predicted(spark, sf)
    parts = [
        (E.squared_loss(rows, "CrossSection", "pred"), "mse", 6), (E.chi_squared(rows.filter("Uncertainty > 0"), "CrossSection", "pred", "Uncertainty"), "chi2", 3),
        (E.chi_squared(rows, "CrossSection", "pred", "Uncertainty"), "chi2_incomplete", 6)]
    out = [df.select(F.lit(name).alias("kind"), rounded("loss", d).alias("loss")) for df, name, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_SLOPES = """
, l AS (SELECT Z, A, MT, log10(Energy) AS x, log10(pred) AS y FROM p),
d AS (SELECT Z, A, MT, x, y, lag(x, 1) OVER w AS x1, lag(y, 1) OVER w AS y1, lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY Z, A, MT ORDER BY x, y)),
e AS (SELECT *, (y - y1) / greatest(x - x1, {step}) AS s1, (x + x1) * 0.5::DOUBLE AS m1, (y1 - y2) / greatest(x1 - x2, {step}) AS s0, (x1 + x2) * 0.5::DOUBLE AS m0 FROM d WHERE x1 IS NOT NULL)"""
_LOG_STEP = 1e-6


def _log_curve(spark, sf):
    return predicted(spark, sf).select(*KEYS, F.log10("Energy").alias("log_e"), F.log10("pred").alias("log_pred"))


@register("m11_smoothness", _PRED_SQL + _SLOPES.format(step="1e-6") + f" SELECT Z, A, MT, {r('avg(abs(s1))', 2)} AS smoothness FROM e GROUP BY ALL")
def smoothness(spark, sf):
    return round_columns(E.smoothness(_log_curve(spark, sf), KEYS, "log_e", "log_pred", _LOG_STEP), "smoothness", digits=2)


@register("m12_resonance_penalties", _PRED_SQL + _SLOPES.format(step="1e-6") + f"""
SELECT Z, A, MT, {r('avg(CASE WHEN m1 < 6.5 THEN (s1 + 0.5) * (s1 + 0.5) END)', 0)} AS slope_penalty, {r('avg(CASE WHEN m1 > 6.5 THEN pow(greatest(-s1, 0), 2) END)', 0)} AS rise_penalty,
       {r('avg(CASE WHEN s0 IS NOT NULL THEN abs((s1 - s0) / greatest(m1 - m0, 1e-6)) END)', 0)} AS curvature_penalty FROM e GROUP BY ALL""")
def resonance(spark, sf):
    out = E.resonance_penalties(_log_curve(spark, sf), KEYS, "log_e", "log_pred", 6.5, 6.5, _LOG_STEP)
    return round_columns(out, "slope_penalty", "rise_penalty", "curvature_penalty", digits=0)


@register("m13_sensitivity_weighted_loss", _PRED_SQL + _SENS_SQL + f"""
, w AS (SELECT abs(log10(pred + 1e-10) - log10(CrossSection + 1e-10)) AS e, coalesce(abs(sensitivity), 0) AS w FROM p LEFT JOIN se USING (Z, A, MT))
SELECT {r('avg(e * e * w) / (max(w) + 1e-10)')} AS mse, {r('avg(e * w) / (max(w) + 1e-10)')} AS mae,
       {r('avg(CASE WHEN e < 1 THEN 0.5 * e * e ELSE e - 0.5 END * w) / (max(w) + 1e-10)')} AS huber FROM w""")
def weighted_loss(spark, sf):
    rows = E.add_sensitivity_weights(predicted(spark, sf), sensitivities(spark, sf), normalize=False)
    parts = [E.sensitivity_weighted_loss(rows, "CrossSection", "pred", "weight", k).select(rounded("loss").alias(k)) for k in ("mse", "mae", "huber")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@register("m14_unitarity_excess", f"""
, g AS (SELECT Z, A, Entry, sum(CASE WHEN MT = 102 THEN CrossSection END) AS t, coalesce(sum(CASE WHEN MT <> 102 THEN CrossSection END), 0) AS p FROM q GROUP BY ALL)
SELECT count(*) AS n_points, {r('avg(greatest(p - t, 0))')} AS excess FROM g WHERE t IS NOT NULL""")
def unitarity(spark, sf):
    return round_columns(E.unitarity_excess(clean(spark, sf), ["Z", "A", "Entry"], "CrossSection", 102), "excess")


@register("m15_below_threshold", f"""
, t AS (SELECT DISTINCT Z, A, MT, Z * 500000.0::DOUBLE AS threshold FROM q WHERE MT = 16)
SELECT {r('avg(CASE WHEN Energy < threshold THEN CrossSection ELSE 0 END)')} AS violation FROM q JOIN t USING (Z, A, MT)""")
def below_threshold(spark, sf):
    rows = clean(spark, sf)
    thresholds = rows.filter("MT = 16").select(*KEYS).distinct().withColumn("threshold", F.col("Z") * 500000.0)
    return round_columns(E.below_threshold(rows, thresholds, KEYS, "CrossSection"), "violation")


@register("m16_derivative_excess", _PRED_SQL + f"""
, d AS (SELECT Z, A, MT, Energy AS x, pred AS y, lag(Energy) OVER w AS x1, lag(pred) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY Z, A, MT ORDER BY Energy, pred))
SELECT Z, A, MT, {r('log10(1 + avg(greatest(abs((y - y1) / (x - x1 + 1e-10)) - 0.001::DOUBLE, 0)))', 5)} AS excess FROM d WHERE x1 IS NOT NULL GROUP BY ALL""")
def derivative_excess(spark, sf):
    # Rows of equal energy differ by 1e-10 there, so the mean spans many decades: compare its logarithm.
    found = E.derivative_excess(predicted(spark, sf), KEYS, "Energy", "pred", bound=0.001)
    return found.select(*KEYS, rounded(F.log10(1 + F.col("excess")), 5).alias("excess"))


@register("m17_negative_penalty", f"SELECT {r('avg(greatest(-(CrossSection - 1), 0))')} AS penalty FROM q")
def negative(spark, sf):
    return round_columns(E.negative_penalty(clean(spark, sf).withColumn("v", F.col("CrossSection") - 1), "v"), "penalty")


@register("m09_clipped_curve", _PRED_SQL + " SELECT Energy, greatest(pred - 3, 1e-10) AS pred FROM p WHERE Z = 2 AND A = 5 AND MT = 18")
def clipped(spark, sf):
    from crossfield.operators.ranking import clipped_curve

    rows = predicted(spark, sf).filter("Z = 2 AND A = 5 AND MT = 18").withColumn("pred", F.col("pred") - 3)
    return clipped_curve(rows, "pred").select("Energy", "pred")


# ----------------------------------------------------------------------- graph
_NODES = ", nd AS (SELECT Z, A, A - Z AS N, CAST(row_number() OVER (ORDER BY Z, A) - 1 AS INT) AS node FROM (SELECT DISTINCT Z, A FROM q))"
_EDGES = _NODES + """, ed AS (SELECT a.node AS source, b.node AS target, MT, CrossSection FROM q JOIN nd a USING (Z, A)
  JOIN nd b ON b.Z = q.Z AND b.A = q.A + CASE MT WHEN 102 THEN 1 WHEN 16 THEN -1 ELSE 0 END WHERE MT IN (2, 16, 102))"""


@register("g01_node_features", _NODES + f"""
SELECT node, Z, A, N, Z / 100.0::DOUBLE AS z_scaled, A / 250.0::DOUBLE AS a_scaled, {r('N / 150.0::DOUBLE')} AS n_scaled, {r('CASE WHEN Z > 0 THEN N / Z::DOUBLE ELSE 0 END')} AS n_over_z,
  {r(f'coalesce(Mass_Excess_keV, -({_SEMF}) * 1000) / 1e6')} AS mass_scaled, {r(f'coalesce(Binding_Energy_keV, -coalesce(Mass_Excess_keV, -({_SEMF}) * 1000)) / 1e6')} AS binding_scaled,
  0::DOUBLE AS is_fissile, CASE WHEN abs(N - Z) < 5 AND Z < 83 THEN 1::DOUBLE ELSE 0 END AS is_stable FROM nd LEFT JOIN (SELECT * EXCLUDE N FROM ref) USING (Z, A)""", reference=True)
def node_features(spark, sf):
    out = graph.node_features(clean(spark, sf), reference(spark, sf))
    return round_columns(out, "n_scaled", "n_over_z", "mass_scaled", "binding_scaled")


@register("g02_edges", _EDGES + f" SELECT source, target, MT, count(*) AS n, {r('avg(log10(CrossSection + 1e-10))')} AS log_xs FROM ed GROUP BY ALL")
def edges(spark, sf):
    return graph.edges(clean(spark, sf)).groupBy("source", "target", "MT").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("log_xs")).alias("log_xs"))


@register("g03_graph_size", _EDGES + " SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges")
def graph_size(spark, sf):
    nodes, links = graph.reaction_graph(clean(spark, sf))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(links.agg(F.count(F.lit(1)).alias("edges")))


@register("g04_energy_slices", f"""
, g AS (SELECT CAST(i AS INT) AS bin, pow(10, i * 7.0 / 99) AS e FROM range(100) t(i))
SELECT bin, count(*) AS n, {r('avg(log10(CrossSection + 1e-10))')} AS log_xs FROM q JOIN g ON abs(Energy - e) <= 1e-8 + 1e-3 * abs(e) GROUP BY bin""")
def energy_slices(spark, sf):
    return graph.energy_slices(clean(spark, sf)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.log10(F.col("CrossSection") + 1e-10))).alias("log_xs"))


@register("g04_energy_slice", _NODES + f"""
SELECT node AS source, node AS target, MT, {r('log10(CrossSection + 1e-10)')} AS log_xs FROM q JOIN nd USING (Z, A) WHERE abs(Energy - 5e6) <= 1e-8 + 1e-3 * 5e6""")
def energy_slice(spark, sf):
    return round_columns(graph.energy_slice(clean(spark, sf), 5e6).select("source", "target", "MT", "log_xs"), "log_xs")


@register("g05_k_hop", _EDGES + """
, l AS (SELECT DISTINCT source AS f, target AS t FROM ed UNION SELECT target, source FROM ed), s0 AS (SELECT node AS nn, 0 AS hop FROM nd WHERE Z = 3 AND A = 6),
s1 AS (SELECT DISTINCT t AS nn, 1 AS hop FROM l JOIN s0 ON f = nn WHERE t NOT IN (SELECT nn FROM s0)),
s2 AS (SELECT DISTINCT t AS nn, 2 AS hop FROM l JOIN s1 ON f = nn WHERE t NOT IN (SELECT nn FROM s0) AND t NOT IN (SELECT nn FROM s1))
SELECT node, hop, Z, A FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) JOIN nd ON node = nn""")
def k_hop(spark, sf):
    nodes, links = graph.reaction_graph(clean(spark, sf))
    return graph.k_hop(links, nodes, 3, 6, 2)


# ---------------------------------------------------------------------- models
def _small(spark, sf):
    return features.tier_features(clean(spark, sf), ["A", "B"])


@register("m01_decision_tree")
def decision_tree(spark, sf):
    model = models.train(_small(spark, sf), models.decision_tree(maxDepth=6))
    return spark.createDataFrame([(k, float(v)) for k, v in model.metrics.items() if v is not None], "metric string, value double")


@register("m07_weighted_training")
def weighted(spark, sf):
    model = models.train(_small(spark, sf), models.decision_tree(weighted=True, maxDepth=6), weight_mode="both")
    return spark.createDataFrame([(k, float(v)) for k, v in model.metrics.items() if v is not None], "metric string, value double")


@register("m02_boosted_trees")
def boosted(spark, sf):
    model = models.train(_small(spark, sf), models.boosted_trees())
    return spark.createDataFrame([(k, float(v)) for k, v in model.metrics.items() if v is not None], "metric string, value double")


@register("m03_predictions")
def predictions(spark, sf):
    rows = stored(_small(spark, sf))
    model = models.train(rows, models.decision_tree(maxDepth=5), weight_mode=None)
    return model.predict(rows).select("Z", "A", "MT", "Energy", "CrossSection", "prediction")


@register("m08_feature_importance")
def importance(spark, sf):
    return models.train(_small(spark, sf), models.decision_tree(maxDepth=5)).importance(spark)


@register("m04_grid_search")
def grid_search(spark, sf):
    tree = models.decision_tree()
    maps = models.grid_maps(tree, {"maxDepth": [2, 4], "minInstancesPerNode": [1, 20]})
    _, found = models.search(_small(spark, sf), tree, maps)
    return spark.createDataFrame([(k, float(v)) for k, v in found["best"].items()], "parameter string, value double")


# Searches whose scores SQL can give: one two-valued feature, so a tree of depth 0 predicts the mean
# and one of depth 1 the mean of each value; splits follow from the experiment's number.
_TWO = ", p AS (SELECT CAST(Entry AS INT) AS key, CASE WHEN Projectile = 'p' THEN 1 ELSE 0 END AS x, log10(CrossSection) AS y FROM q)"


def _cross_validated(rows: str, out: str) -> str:
    """Mean over three folds of the squared error, for both depths."""
    return f"""
, {out}f AS (SELECT key % 3 AS fold, x, y FROM {rows}),
{out}s AS (SELECT f.fold, avg(pow(f.y - (SELECT avg(y) FROM {out}f o WHERE o.fold <> f.fold), 2)) AS d0,
  avg(pow(f.y - (SELECT avg(y) FROM {out}f o WHERE o.fold <> f.fold AND o.x = f.x), 2)) AS d1 FROM {out}f f GROUP BY f.fold),
{out} AS (SELECT 0 AS depth, avg(d0) AS score FROM {out}s UNION ALL SELECT 1, avg(d1) FROM {out}s)"""


# Trees that SQL can grow: features of few values, so thresholds lie midway between neighbours, a
# node's best split has the least squared error, and a leaf predicts its mean.
def _best(node: str, out: str, target: str = "y", weight: str = "1.0") -> str:
    """The best split of every node (column ``node``) of a table: feature, threshold, both means.

    Sums per value first; running sums over the values give both sides of every threshold.
    """
    gain = "s * s / w + (t - s) * (t - s) / (v - w)"
    return f"""
, {out}v AS (SELECT node, feature, x, sum({weight}) AS w0, sum({weight} * {target}) AS s0
  FROM {node} UNPIVOT (x FOR feature IN (f1, f2)) GROUP BY ALL),
{out}r AS (SELECT *, sum(w0) OVER (PARTITION BY node, feature ORDER BY x) AS w, sum(s0) OVER (PARTITION BY node, feature ORDER BY x) AS s,
  sum(w0) OVER (PARTITION BY node, feature) AS v, sum(s0) OVER (PARTITION BY node, feature) AS t,
  (x + lead(x) OVER (PARTITION BY node, feature ORDER BY x)) / 2.0 AS threshold FROM {out}v),
{out} AS (SELECT node, arg_max(feature, {gain}) AS feature, arg_max(threshold, {gain}) AS threshold,
  arg_max(s / w, {gain}) AS low, arg_max((t - s) / (v - w), {gain}) AS high, max({gain}) - any_value(t * t / v) AS gain
  FROM {out}r WHERE threshold IS NOT NULL GROUP BY node)"""


def _side(split: str = "b") -> str:
    return f"CASE {split}.feature WHEN 'f1' THEN f1 ELSE f2 END <= {split}.threshold"


_FEW = ", p AS (SELECT 0 AS node, Z::DOUBLE AS f1, CASE MT WHEN 102 THEN 2 WHEN 18 THEN 1 ELSE 0 END::DOUBLE AS f2, log10(CrossSection + 1e-10) AS y, Uncertainty, CrossSection FROM q)"
_STUMP = _FEW + _best("p", "b")
_DEEP = _STUMP + f", d AS (SELECT CASE WHEN {_side()} THEN 1 ELSE 2 END AS node, f1, f2, y FROM p, b)" + _best("d", "c")


def _few_valued(spark, sf):
    code = F.when(F.col("MT") == 102, 2).when(F.col("MT") == 18, 1).otherwise(0)
    return clean(spark, sf).select("CrossSection", "Uncertainty", F.col("Z").alias("f1"), code.alias("f2"))


def _plain_scaler():
    return Scaler(TransformConfig(scaler="none"))


def _predicted(model, rows):
    """What the model says for every combination of the features, and for how many rows."""
    out = model.predict(rows).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction_log").alias("predicted"))
    return round_columns(out, "predicted").select(F.col("f1").cast("int").alias("f1"), F.col("f2").cast("int").alias("f2"), "n", "predicted")


def _grown(spark, sf, estimator, **options):
    rows = _few_valued(spark, sf)
    return _predicted(models.train(rows, estimator, _plain_scaler(), test_fraction=0.0, features=["f1", "f2"], **options), rows)


_CELLS = "SELECT f1::INT AS f1, f2::INT AS f2, count(*) AS n, {value} AS predicted FROM {rows} GROUP BY ALL"


@register("m01_stump_by_sql", _STUMP + f", e AS (SELECT f1, f2, CASE WHEN {_side()} THEN low ELSE high END AS o FROM p, b) "
          + _CELLS.format(value=r("avg(o)"), rows="e"))
def stump(spark, sf):
    return _grown(spark, sf, models.decision_tree(maxDepth=1))


@register("m03_two_levels_by_sql", _DEEP + f", e AS (SELECT f1, f2, CASE WHEN {_side('c')} THEN c.low ELSE c.high END AS o FROM d JOIN c USING (node)) "
          + _CELLS.format(value=r("avg(o)"), rows="e"))
def two_levels(spark, sf):
    return _grown(spark, sf, models.decision_tree(maxDepth=2))


# The second tree grows on twice the residuals of the first and counts with the step size.
@register("m02_boosting_by_sql", _STUMP + f"""
, g AS (SELECT 0 AS node, f1, f2, y, CASE WHEN {_side()} THEN low ELSE high END AS o FROM p, b), h AS (SELECT *, 2.0 * (y - o) AS z FROM g)"""
          + _best("h", "c", "z") + f", e AS (SELECT f1, f2, o + 0.1 * CASE WHEN {_side('c')} THEN c.low ELSE c.high END AS o FROM h, c) "
          + _CELLS.format(value=r("avg(o)"), rows="e"))
def two_boosted(spark, sf):
    return _grown(spark, sf, models.boosted_trees(maxIter=2, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all"))


_WEIGHED = """
, u AS (SELECT p.*, 1.0 / pow(Uncertainty / (CrossSection * ln(10::DOUBLE)), 2) AS raw FROM p), um AS (SELECT quantile_cont(raw, 0.5) AS m FROM u),
uf AS (SELECT u.* EXCLUDE (raw), coalesce(raw, m) AS raw FROM u, um), uc AS (SELECT quantile_cont(raw, 0.99) AS cap FROM uf),
ul AS (SELECT uf.* EXCLUDE (raw), least(raw, cap) AS raw FROM uf, uc), pw AS (SELECT * EXCLUDE (raw), raw / (SELECT avg(raw) FROM ul) AS w FROM ul)"""


@register("m07_weighted_stump_by_sql", _FEW + _WEIGHED + _best("pw", "b", "y", "w")
          + f", e AS (SELECT f1, f2, CASE WHEN {_side()} THEN low ELSE high END AS o FROM pw, b) " + _CELLS.format(value=r("avg(o)"), rows="e"))
def weighted_stump(spark, sf):
    return _grown(spark, sf, models.decision_tree(weighted=True, maxDepth=1), weight_mode="xs")


# A feature's importance is its share of the gain of all splits.
@register("m08_importance_by_sql", _DEEP + f"""
, i AS (SELECT feature, gain FROM b UNION ALL SELECT feature, gain FROM c), n AS (SELECT unnest(['f1', 'f2']) AS feature)
SELECT feature, {r('coalesce(sum(gain), 0) / (SELECT sum(gain) FROM i)')} AS importance FROM n LEFT JOIN i USING (feature) GROUP BY feature""")
def importance_by_sql(spark, sf):
    rows = _few_valued(spark, sf)
    model = models.train(rows, models.decision_tree(maxDepth=2), _plain_scaler(), test_fraction=0.0, features=["f1", "f2"])
    return round_columns(model.importance(spark), "importance")


def _two_valued(spark, sf):
    return clean(spark, sf).select("CrossSection", "Entry", (F.col("Projectile") == "p").cast("int").alias("proton"))


def _scores(spark, scores, best):
    rows = [(int(p["maxDepth"]), float(s), p == best) for p, s in scores]
    return spark.createDataFrame(rows, "depth int, score double, chosen boolean").withColumn("score", rounded("score", 7))


_CHOSEN = f"SELECT depth, {r('score', 7)} AS score, score = (SELECT min(score) FROM c) AS chosen FROM c"


@register("m04_folds_by_key", _TWO + _cross_validated("p", "c") + _CHOSEN)
def folds_by_key(spark, sf):
    tree = models.decision_tree()
    _, found = models.search(_two_valued(spark, sf), tree, models.grid_maps(tree, {"maxDepth": [0, 1]}), key=F.col("Entry"))
    return _scores(spark, found["scores"], found["best"])


@register("m05_random_by_key", _TWO + _cross_validated("p", "c") + _CHOSEN)
def random_by_key(spark, sf):
    tree = models.decision_tree()
    _, found = models.search(_two_valued(spark, sf), tree, models.random_maps(tree, {"maxDepth": [0, 1]}, 2), key=F.col("Entry"))
    return _scores(spark, found["scores"], found["best"])


# A first round on a tenth of the rows by their draw decides between the two.
@register("m06_halving_by_key", _TWO + """
, h AS (SELECT * FROM p WHERE key // 3 % 10000 < -((-10000 * ((SELECT count(*) FROM p) // 10)) // (SELECT count(*) FROM p)))""" + _cross_validated("h", "c") + _CHOSEN)
def halving_by_key(spark, sf):
    rows = _two_valued(spark, sf)
    tree = models.decision_tree()
    _, found = models.successive_halving(
        rows, tree, models.grid_maps(tree, {"maxDepth": [0, 1]}), min_rows=rows.count() // 10, key=F.col("Entry"))
    return _scores(spark, found["rounds"][0], found["best"])


@register("m07_holdout_by_key", _TWO + f"""
, t AS (SELECT avg(y) AS m, avg(y) FILTER (x = 0) AS m0, avg(y) FILTER (x = 1) AS m1 FROM p WHERE key % 100 < 70),
c AS (SELECT 0 AS depth, avg(pow(y - m, 2)) FILTER (key % 100 < 85) AS score, avg(pow(y - m, 2)) FILTER (key % 100 >= 85) AS test FROM p, t WHERE key % 100 >= 70
  UNION ALL SELECT 1, avg(pow(y - CASE x WHEN 0 THEN m0 ELSE m1 END, 2)) FILTER (key % 100 < 85),
  avg(pow(y - CASE x WHEN 0 THEN m0 ELSE m1 END, 2)) FILTER (key % 100 >= 85) FROM p, t WHERE key % 100 >= 70)
SELECT depth, {r('score', 7)} AS score, score = (SELECT min(score) FROM c) AS chosen,
  (SELECT {r('arg_min(test, score)', 7)} FROM c) AS test FROM c""")
def holdout_by_key(spark, sf):
    tree = models.decision_tree()
    _, found = models.search(
        _two_valued(spark, sf), tree, models.grid_maps(tree, {"maxDepth": [0, 1]}), validation="holdout", key=F.col("Entry"))
    return _scores(spark, found["scores"], found["best"]).withColumn("test", rounded(F.lit(found["test_mse"]), 7))


@register("k06_experiment_round_trip", "SELECT count(*) AS n, count(*) AS equal, 1 AS features, 'kept' AS note FROM q")
def experiment_round_trip(spark, sf):
    """A trained model saved with its properties, loaded again, predicts the same for every row."""
    rows, path = _two_valued(spark, sf).drop("Entry"), new_folder(spark, "experiment")
    model = models.train(rows, models.decision_tree(maxDepth=1))
    models.save_experiment(model, spark, path, note="kept")
    again, properties = models.load_experiment(spark, path)
    both = again.predict(model.predict(rows, "first").withColumnRenamed("prediction_log", "first_log"), "second")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == F.col("second")).alias("equal"),
        F.lit(len(properties["features"])).alias("features"), F.lit(properties["extra"]["note"]).alias("note"))
