"""Query registry, the measurement view over the driver tables, and SQL pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfield.operators import outliers, quality
from crossfield.sources.store import shared_result

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Measurement columns computed from the fact table; the text is valid in both engines.
VIEW = {
    "Entry": "CAST(l_suppkey AS STRING)",
    "Z": "CAST(l_linenumber AS INT)",
    "A": "CAST(l_linenumber AS INT) + CAST(l_quantity AS INT) % 10",
    "MT": "CASE l_returnflag WHEN 'A' THEN 102 WHEN 'N' THEN 18 ELSE 16 END",
    "Projectile": "CASE l_linestatus WHEN 'O' THEN 'n' ELSE 'p' END",
    "Energy": "l_extendedprice * 100",
    "Energy_Uncertainty": "CASE WHEN l_tax > 0 THEN l_tax * l_extendedprice END",
    "CrossSection": "l_discount * l_extendedprice / 1000",
    "Uncertainty": "CASE WHEN l_tax > 0 THEN l_tax * l_discount * l_extendedprice / 1000 END",
    "sf5": "CASE l_partkey % 4 WHEN 0 THEN 'CUM' WHEN 1 THEN ' ' END",
    "sf6": "CASE l_partkey % 5 WHEN 0 THEN 'SIG/RAT' WHEN 1 THEN 'DA' ELSE 'SIG' END",
    "sf8": "CASE l_partkey % 8 WHEN 1 THEN 'REL' WHEN 2 THEN 'BRS/REL' WHEN 3 THEN 'MXW' WHEN 4 THEN 'RAW' "
           "WHEN 5 THEN 'SDT/AV' WHEN 6 THEN 'RES' WHEN 7 THEN 'TTA' END",
    "sf9": "CASE l_suppkey % 6 WHEN 0 THEN 'CALC' WHEN 1 THEN 'EXP' END",
}
KEYS = ["Z", "A", "MT"]
FULL_KEYS = [*KEYS, "Projectile"]

_VIEW_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in VIEW.items()) + " FROM lineitem"
_CLEAN_SQL = (
    "SELECT *, A - Z AS N FROM m WHERE A <> 0 AND Energy BETWEEN 1e-5 AND 1e9 "
    "AND CrossSection BETWEEN 1e-10 AND 1e6"
)
# Median and MAD scores per (Z, A, MT) with experiment flags, over the clean rows.
_SCORED_SQL = """
s0 AS (SELECT *, log10(Energy) AS log_E, log10(CrossSection) AS log_sigma FROM q),
s1 AS (SELECT Z, A, MT, quantile_cont(log_sigma, 0.5) AS gp_mean FROM s0 GROUP BY ALL),
s2 AS (SELECT s0.*, gp_mean, abs(log_sigma - gp_mean) AS away FROM s0 JOIN s1 USING (Z, A, MT)),
s3 AS (SELECT Z, A, MT, quantile_cont(away, 0.5) * 1.4826::DOUBLE AS mad, count(*) AS grp,
              count(DISTINCT Entry) AS exps FROM s2 GROUP BY ALL),
s4 AS (SELECT s2.*, grp, exps, CASE WHEN mad < 1e-10 THEN 1e-6 ELSE mad END AS gp_std FROM s2 JOIN s3 USING (Z, A, MT)),
s5 AS (SELECT *, away / gp_std AS z_score, away / gp_std > 3 AS point_outlier FROM s4),
s6 AS (SELECT Z, A, MT, Entry, avg(CASE WHEN z_score > 3 THEN 1.0 ELSE 0.0 END) AS bad FROM s5 GROUP BY ALL),
s AS (SELECT s5.*, (bad > 0.3 AND exps > 1 AND grp >= 10) AS experiment_outlier
      FROM s5 JOIN s6 USING (Z, A, MT, Entry))"""
# Nuclide reference: one row per nuclide, every seventh mass number unknown.
REFERENCE = {
    "Mass_Excess_keV": "Z * 1000.0 + A * 12.5",
    "Binding_Energy_keV": "A * 8000.0 - Z * 3.5",
    "Binding_Per_Nucleon_keV": "(A * 8000.0 - Z * 3.5) / A",
    "S_1n_keV": "Z * 100.0 + A", "S_2n_keV": "Z * 200.0 + A",
    "S_1p_keV": "Z * 50.0 + A", "S_2p_keV": "Z * 150.0 + A",
    "Q_alpha_keV": "A * 11.0", "Q_2beta_minus_keV": "A * 12.0", "Q_ep_keV": "A * 13.0", "Q_beta_n_keV": "A * 14.0",
    "Q_4beta_minus_keV": "A * 15.0", "Q_d_alpha_keV": "A * 16.0", "Q_p_alpha_keV": "A * 17.0", "Q_n_alpha_keV": "A * 18.0",
    "Spin": "(A % 6) / 2.0", "Parity": "CASE WHEN A % 2 = 0 THEN 1 ELSE -1 END", "Isomer_Level": "0",
    "Half_Life_s": "CASE A % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1e30 ELSE A * 3600.0 END",
}
# Spark reads plain decimals as exact numbers; the E0 suffix makes them doubles there.
_REF_SQL = ("SELECT Z, A, A - Z AS N, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in REFERENCE.items())
            + " FROM (SELECT DISTINCT Z, A FROM m) WHERE A % 7 <> 0")


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*[f"{e} AS {c}" for c, e in VIEW.items()])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_filter(measurements(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The scored measurements that many reports start from: stored by the first of them."""
    config = outliers.OutlierConfig()

    def build() -> DataFrame:
        rows = outliers.prepare(clean(spark, sf), config)
        return outliers.score_experiments(rows, KEYS, "Entry", config=config)

    settings = {"view": VIEW, "keys": KEYS, "entry": "Entry", "config": asdict(config)}
    return shared_result(spark, "scored", [f"{sf}/lineitem.parquet"], settings, build)


def reference(spark: SparkSession, sf: str) -> DataFrame:
    nuclides = measurements(spark, sf).select("Z", "A").distinct().filter("A % 7 <> 0")
    return nuclides.selectExpr("Z", "A", "A - Z AS N", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in REFERENCE.items()])


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Half-up in plain double arithmetic, which both engines do alike."""
    c = F.col(c) if isinstance(c, str) else c
    factor = float(10 ** digits)
    return F.floor(c.cast("double") * factor + 0.5) / factor


def r(expression: str, digits: int = 6) -> str:
    """The SQL twin of ``rounded``."""
    factor = f"{10 ** digits}::DOUBLE"
    return f"floor(CAST({expression} AS DOUBLE) * {factor} + 0.5::DOUBLE) / {factor}"


def round_columns(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def sql(body: str, *, scored: bool = False, reference: bool = False) -> str:
    """Complete a query: ``body`` is a SELECT, or ``, name AS (...) ... SELECT``."""
    parts = [f"m AS ({_VIEW_SQL})", f"q AS ({_CLEAN_SQL})"]
    if scored:
        parts.append(_SCORED_SQL)
    if reference:
        parts.append(f"ref AS ({_REF_SQL})")
    joint = "" if body.lstrip().startswith(",") else " "
    return "WITH " + ", ".join(parts) + joint + body


def register(name: str, oracle: str | None = None, **options: bool) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle, **options)
        return fn
    return add
