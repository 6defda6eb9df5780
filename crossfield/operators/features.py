"""Tiered feature frames: a projection over enriched measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions import scalars as S
from crossfield.operators.reference import TIER_COLUMNS, enrich

ALWAYS = ["Entry", "MT", "CrossSection", "Uncertainty"]


def _mev_name(column: str) -> str:
    return column.removesuffix("_keV") + "_MeV"


TIER_OUTPUT = {
    "A": ["Z", "A", "N", "Energy"],
    "B": ["R_fm", "kR"],
    "C": [_mev_name(c) for c in TIER_COLUMNS["C"]],
    "D": [
        "Spin", "Parity", "Isomer_Level", "Half_Life_log10_s", "Valence_N", "Valence_P",
        "P_Factor", "Shell_Closure_N", "Shell_Closure_P",
    ],
    "E": [_mev_name(c) for c in TIER_COLUMNS["E"]],
}


def output_columns(tiers: Sequence[str], particles: bool = True, extra: Sequence[str] = ()) -> list[str]:
    names = {*ALWAYS, *extra}
    for tier in (tiers or ["A"]):
        names |= set(TIER_OUTPUT[tier])
        if tier == "A" and particles:
            names |= set(K.PARTICLE_COLUMNS)
    return sorted(names)


def add_particles(df: DataFrame) -> DataFrame:
    return df.withColumns(S.particle_vector("MT"))


def add_geometry(df: DataFrame) -> DataFrame:
    return df.withColumns({"R_fm": S.radius_fm("A"), "kR": S.k_times_radius("Energy", "A")})


def kev_to_mev(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Energies in MeV under new names; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({_mev_name(c): F.col(c) / 1000.0 for c in present}).drop(*present)


def add_energetics(df: DataFrame) -> DataFrame:
    if not {"Mass_Excess_keV", "Binding_Energy_keV", "S_1n_keV"} <= set(df.columns):
        return df
    return kev_to_mev(df, TIER_COLUMNS["C"])


def add_shells(df: DataFrame) -> DataFrame:
    if not {"Spin", "Parity"} <= set(df.columns):
        return df
    vn, vp = S.valence("N"), S.valence("Z")
    out = df.withColumns({
        "Valence_N": vn, "Valence_P": vp, "P_Factor": S.promiscuity(vn, vp),
        "Shell_Closure_N": S.shell_closure("N"), "Shell_Closure_P": S.shell_closure("Z"),
    })
    if "Half_Life_s" in df.columns:
        out = out.withColumn("Half_Life_log10_s", S.half_life_log10("Half_Life_s")).drop("Half_Life_s")
    return out


def add_reaction_energies(df: DataFrame) -> DataFrame:
    if not {"Q_alpha_keV", "Q_n_alpha_keV"} & set(df.columns):
        return df
    return kev_to_mev(df, TIER_COLUMNS["E"])


def tier_features(
    df: DataFrame, tiers: Sequence[str] = ("A",), particles: bool = True, extra: Sequence[str] = ()
) -> DataFrame:
    """Columns of the requested tiers, in alphabetical order, plus the row's metadata."""
    out = df
    if "A" in tiers or not tiers:
        if "N" not in out.columns:
            out = out.withColumn("N", F.col("A") - F.col("Z"))
        if particles and "MT" in out.columns:
            out = add_particles(out)
    for tier, step in (("B", add_geometry), ("C", add_energetics), ("D", add_shells), ("E", add_reaction_energies)):
        if tier in tiers:
            out = step(out)
    return out.select(*[c for c in output_columns(tiers, particles, extra) if c in out.columns])


def tabular(
    df: DataFrame, reference: DataFrame | None, tiers: Sequence[str] = ("A",),
    reactions: Sequence[int] | None = None, particles: bool = True, extra: Sequence[str] = (),
) -> DataFrame:
    """Enrich, restrict to some reactions, derive features: training and holdout alike."""
    rows = df.filter(F.col("MT").isin(list(reactions))) if reactions else df
    return tier_features(enrich(rows, reference, tiers), tiers, particles, extra)
