"""Normalising raw extracts and the physical quality chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions.scalars import finite, nan_to_null
from crossfield.plans.quantiles import column_percentiles
from crossfield.schema import COLUMN_ALIASES, DIAGNOSTIC_COLUMNS, METADATA_COLUMNS, REQUIRED_COLUMNS

CORE_COLUMNS = [
    "Entry", "Z", "A", "Projectile", "MT", "Energy", "Energy_Uncertainty", "CrossSection", "Uncertainty",
]
_CASTS = {
    "Entry": "string", "Projectile": "string", "Z": "int", "A": "int", "MT": "int",
    "Energy": "double", "CrossSection": "double", "Energy_Uncertainty": "double", "Uncertainty": "double",
}
_DEFAULTS = {"Entry": "UNKNOWN", "Projectile": None, "Energy_Uncertainty": None, "Uncertainty": None}


def normalize(df: DataFrame) -> DataFrame:
    """Canonical names, defaults and types; rows lacking a required value are dropped.

    NaN becomes NULL here, once, so that later comparisons need not care.
    """
    lower = {c.lower(): c for c in df.columns}
    found: dict[str, str] = {}
    for canonical, spellings in COLUMN_ALIASES.items():
        hit = next((lower[s] for s in spellings if s in lower), None)
        if hit is not None:
            found[canonical] = hit
    missing = [c for c in REQUIRED_COLUMNS if c not in found]
    if missing:
        raise ValueError(f"required columns missing: {missing}")

    def value(name: str) -> Column:
        if name not in found:
            return F.lit(_DEFAULTS[name]).cast(_CASTS[name])
        raw = F.col(found[name])
        return nan_to_null(raw.cast("double")).cast("double") if _CASTS[name] == "double" else raw.cast(_CASTS[name])

    kept = [F.col(lower[c.lower()]).alias(c) for c in METADATA_COLUMNS if c.lower() in lower]
    kept += [F.col(found[c]).alias(c) for c in DIAGNOSTIC_COLUMNS if c in found]
    return df.select(*[value(c).alias(c) for c in CORE_COLUMNS], *kept).dropna(subset=REQUIRED_COLUMNS)


def quality_stages() -> dict[str, Column]:
    """The rules in order; a row leaves at the first rule it fails."""
    energy, xs = F.col("Energy"), F.col("CrossSection")
    return {
        "natural_target": F.col("A") != 0,
        "energy_positive": energy > 0,
        "cross_section_positive": xs > 0,
        "finite": finite(energy) & finite(xs),
        "physical_range": energy.between(*K.ENERGY_LIMITS) & xs.between(*K.CROSS_SECTION_LIMITS),
    }


def quality_filter(df: DataFrame) -> DataFrame:
    """All rules as one filter, then the neutron number."""
    kept = df
    for rule in quality_stages().values():
        kept = kept.filter(rule)
    return kept.withColumn("N", F.col("A") - F.col("Z"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no valid rows left after quality filtering")
    return df


def stage_counts(df: DataFrame, stages: dict[str, Column] | None = None) -> DataFrame:
    """Rows removed by each rule, rows kept and the retained share, in one pass."""
    stages = stages or quality_stages()
    alive, counters = F.lit(True), []
    for name, rule in stages.items():
        passes = F.coalesce(rule, F.lit(False))
        counters.append(F.count_if(alive & ~passes).alias(f"removed_{name}"))
        alive = alive & passes
    out = df.agg(F.count(F.lit(1)).alias("initial"), *counters, F.count_if(alive).alias("final"))
    share = F.when(F.col("initial") > 0, F.col("final") / F.col("initial"))
    return out.withColumn("retained_share", share)


def key_filter(df: DataFrame, column: str, keys: list[int]) -> DataFrame:
    """Plain IN list on one column, which Parquet scans push down."""
    return df.filter(F.col(column).isin(keys)) if keys else df


def unit_sanity(df: DataFrame) -> DataFrame:
    """Exact medians and the warnings they raise about units."""
    medians = column_percentiles(df, {"energy": "Energy", "xs": "CrossSection"}, {"median": 0.5}).select(
        F.col("energy__median").alias("median_energy"), F.col("xs__median").alias("median_xs"))
    e, x = F.col("median_energy"), F.col("median_xs")
    return medians.select(
        e, x,
        F.when(e > 1e12, "energy_too_high").when(e < 1e-8, "energy_very_low").otherwise("ok").alias("energy_check"),
        F.when(x < 1e-15, "xs_too_low").when(x > 1e9, "xs_too_high").otherwise("ok").alias("xs_check"),
    )
