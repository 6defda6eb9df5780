"""The nuclide reference table and its join to measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield.functions.scalars import binding_energy_mev, mass_excess_kev
from crossfield.plans.scale import attach, materialize

STRUCTURE_COLUMNS = ["Spin", "Parity", "Isomer_Level", "Half_Life_s"]
MASS_COLUMNS = ["Mass_Excess_keV", "Binding_Energy_keV", "Binding_Per_Nucleon_keV"]
TIER_COLUMNS = {
    "A": [],
    "B": MASS_COLUMNS,
    "C": [*MASS_COLUMNS, "S_1n_keV", "S_2n_keV", "S_1p_keV", "S_2p_keV"],
    "D": STRUCTURE_COLUMNS,
    "E": [
        "Q_alpha_keV", "Q_2beta_minus_keV", "Q_ep_keV", "Q_beta_n_keV",
        "Q_4beta_minus_keV", "Q_d_alpha_keV", "Q_p_alpha_keV", "Q_n_alpha_keV",
    ],
}
NUCLIDE = ["Z", "A"]


def tier_columns(tiers: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(c for t in "ABCDE" if t in tiers for c in TIER_COLUMNS[t]))


def build_reference(
    masses: DataFrame, energies_1: DataFrame | None = None, energies_2: DataFrame | None = None,
    structure: DataFrame | None = None,
) -> DataFrame:
    """Masses with reaction energies and structure; isomers inherit their ground state.

    A column on both sides takes the structure table's value where it has one. Isomers
    of a nuclide without a mass are left out.
    """
    table = masses
    for side in (energies_1, energies_2):
        if side is not None:
            table = table.join(side, NUCLIDE, "left")
    if structure is None:
        return table
    ground = structure.filter("Isomer_Level = 0")
    shared = [c for c in ground.columns if c in table.columns and c not in NUCLIDE]
    renamed = ground.withColumnsRenamed({c: f"__{c}" for c in shared})
    merged = table.join(renamed, NUCLIDE, "left").withColumns(
        {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in shared}).drop(*[f"__{c}" for c in shared])
    return merged.unionByName(isomer_rows(merged, structure))


def isomer_rows(ground: DataFrame, structure: DataFrame) -> DataFrame:
    """Isomer states with the ground row's other columns."""
    states = structure.filter("Isomer_Level > 0").select(*NUCLIDE, *STRUCTURE_COLUMNS)
    one = ground.dropDuplicates(NUCLIDE).drop(*STRUCTURE_COLUMNS)
    return states.join(one, NUCLIDE).select(*ground.columns)


def ground_states(reference: DataFrame) -> DataFrame:
    if "Isomer_Level" not in reference.columns:
        return reference
    return reference.filter(F.coalesce(F.col("Isomer_Level"), F.lit(0)) == 0)


def require_unique(reference: DataFrame, keys: Sequence[str] = NUCLIDE) -> DataFrame:
    """The join must not multiply rows, so the right side has one row per key."""
    reference = materialize(reference)
    if not reference.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"reference table has several rows for one of {list(keys)}")
    return reference


def enrich(
    df: DataFrame, reference: DataFrame | None, tiers: Sequence[str] | None = None, suffix: str = "_ref"
) -> DataFrame:
    """Left join of the ground-state reference columns the tiers need.

    Nothing is joined when no tier beyond A is asked for, when the columns are already
    there, or when there is no reference. Name clashes get a suffix. Rows keep their count.
    """
    if reference is None or (tiers is not None and not set(tiers) - {"A"}):
        return df
    wanted = [c for c in reference.columns if c not in (*NUCLIDE, "N")]
    if tiers is not None:
        needed = tier_columns(tiers)
        wanted = [c for c in needed if c in reference.columns]
        if wanted and all(c in df.columns for c in wanted):
            return df
    right = require_unique(ground_states(reference).select(*NUCLIDE, *wanted))
    clashes = {c: c + suffix for c in wanted if c in df.columns}
    return attach(df, right.withColumnsRenamed(clashes), NUCLIDE)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of rows with a value, per reference column."""
    return df.agg(*[
        (100.0 * F.count(c) / F.count(F.lit(1))).alias(f"{c}_pct") for c in columns if c in df.columns])


def lookup(reference: DataFrame, z: int, a: int, tiers: Sequence[str] | None = None) -> DataFrame:
    """The row of one nuclide, empty when it is unknown."""
    row = reference.filter((F.col("Z") == z) & (F.col("A") == a)).limit(1)
    if tiers is None:
        return row
    return row.select(*NUCLIDE, *[c for c in ["N", *tier_columns(tiers)] if c in reference.columns])


def fill_missing_masses(df: DataFrame) -> DataFrame:
    """Formula values where no measured mass was found."""
    return df.withColumns({
        "Mass_Excess_keV": F.coalesce(F.col("Mass_Excess_keV"), mass_excess_kev("Z", "A")),
        "Binding_Energy_keV": F.coalesce(F.col("Binding_Energy_keV"), binding_energy_mev("Z", "A") * 1000.0),
    })
