"""Selections and holdouts as column predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions.scalars import finite, in_ranges
from crossfield.operators.classify import has_token

MT_MODES = {
    "reactor_core": K.MT_REACTOR_CORE,
    "threshold_only": K.MT_THRESHOLD_ONLY,
    "fission_details": K.MT_FISSION_DETAILS,
    "all_physical": None,
}


def _any(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def _false_if_null(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


@dataclass
class Holdout:
    """Rules of held-out phase space: AND inside a rule, OR over rules.

    A rule may name Z, A, MT, Entry (scalar or list), ``energy_range`` and ``xs_range``
    (inclusive).
    """

    rules: list[dict[str, Any]] = field(default_factory=list)

    def predicate(self) -> Column:
        if not self.rules:
            return F.lit(False)
        return _false_if_null(_any([self._rule(r) for r in self.rules]))

    @staticmethod
    def _rule(rule: dict[str, Any]) -> Column:
        parts = []
        for name in ("Z", "A", "MT", "Entry"):
            if name in rule:
                wanted = rule[name]
                parts.append(F.col(name).isin(list(wanted)) if isinstance(wanted, (list, tuple))
                             else F.col(name) == wanted)
        for name, column in (("energy_range", "Energy"), ("xs_range", "CrossSection")):
            if name in rule:
                parts.append(F.col(column).between(*rule[name]))
        return _all(parts)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Training rows and held-out rows; together exactly the input."""
        held = self.predicate()
        return df.filter(~held), df.filter(held)


@dataclass
class Selection:
    """What to load. Every part is applied, whatever the file layout."""

    projectile: str | Sequence[str] = "neutron"
    energy_min: float = 1e-5
    energy_max: float = 2e7
    mt_mode: str = "reactor_core"
    custom_mt: Sequence[int] | None = None
    exclude_mt: Sequence[int] = ()
    tiers: Sequence[str] = ("A",)
    exclude_spectrum_averaged: bool = True
    holdout: Holdout | None = None
    z_threshold: float | None = None
    include_outliers: bool = True
    exclude_discrepant_experiments: bool = False
    drop_invalid: bool = True

    def __post_init__(self) -> None:
        if self.energy_min <= 0 or self.energy_max <= self.energy_min:
            raise ValueError("need 0 < energy_min < energy_max")
        if self.mt_mode not in (*MT_MODES, "custom"):
            raise ValueError(f"unknown mt_mode {self.mt_mode!r}")
        if self.mt_mode == "custom" and not self.custom_mt:
            raise ValueError("mt_mode 'custom' needs custom_mt")
        if self.z_threshold is not None and self.z_threshold <= 0:
            raise ValueError("z_threshold must be positive")
        if not set(self.tiers) <= set("ABCDE"):
            raise ValueError(f"unknown tier in {list(self.tiers)}")

    # -- reaction numbers
    def mt_codes(self) -> list[int] | None:
        """The listed reactions less the excluded ones; None when all are wanted."""
        listed = list(self.custom_mt) if self.mt_mode == "custom" else MT_MODES[self.mt_mode]
        if listed is None:
            return None
        return [mt for mt in listed if not self._excluded(mt)]

    def _excluded(self, mt: int) -> bool:
        lumped = K.MT_LUMPED_FROM in self.exclude_mt and mt >= K.MT_LUMPED_FROM
        return mt in self.exclude_mt or lumped

    def scan_predicate(self) -> Column:
        """Energy window and reaction list: comparisons with literals, so they push down."""
        parts = [F.col("Energy").between(self.energy_min, self.energy_max)]
        codes = self.mt_codes()
        if codes is not None:
            parts.append(F.col("MT").isin(codes))
        else:
            literal = [mt for mt in self.exclude_mt if mt != K.MT_LUMPED_FROM]
            if literal:
                parts.append(~F.col("MT").isin(literal))
            if K.MT_LUMPED_FROM in self.exclude_mt:
                parts.append(F.col("MT") < K.MT_LUMPED_FROM)
        return _all(parts)

    # -- projectile
    def projectile_codes(self) -> list[str] | None:
        if isinstance(self.projectile, str):
            named = {"neutron": ["n"], "all": None}
            return named.get(self.projectile, [self.projectile.lower()])
        if not self.projectile:
            raise ValueError("projectile list must not be empty")
        return [p.lower() for p in self.projectile]

    def filter_projectile(self, df: DataFrame) -> DataFrame:
        """By the column when it holds anything; else neutrons by reaction number."""
        codes = self.projectile_codes()
        if codes is None:
            return df
        if "Projectile" in df.columns and not df.filter(F.col("Projectile").isNotNull()).isEmpty():
            return df.filter(F.lower("Projectile").isin(codes))
        return df.filter(in_ranges("MT", K.MT_NEUTRON_RANGES)) if codes == ["n"] else df

    # -- the whole chain
    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Training rows and, with a holdout, the held-out rows."""
        rows = self.filter_projectile(df.filter(self.scan_predicate()))
        if self.exclude_spectrum_averaged:
            rows = drop_spectrum_averaged(rows)
        held = None
        if self.holdout and self.holdout.rules:
            rows, held = self.holdout.split(rows)
        if self.z_threshold is not None and not self.include_outliers:
            rows = drop_point_outliers(rows, self.z_threshold)
        if self.exclude_discrepant_experiments:
            rows = drop_discrepant(rows)
        return (drop_invalid(rows) if self.drop_invalid else rows), held


def drop_spectrum_averaged(df: DataFrame) -> DataFrame:
    return df.filter(~has_token("sf8", K.SF8_SPECTRUM_AVERAGED)) if "sf8" in df.columns else df


def drop_point_outliers(df: DataFrame, threshold: float) -> DataFrame:
    """Rows without a score are dropped too."""
    return df.filter(F.col("z_score") <= threshold) if "z_score" in df.columns else df


def drop_discrepant(df: DataFrame) -> DataFrame:
    if "experiment_outlier" not in df.columns:
        return df
    return df.filter(~_false_if_null(F.col("experiment_outlier")))


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.filter((F.col("A") >= 1) & F.col("CrossSection").isNotNull() & (F.col("CrossSection") > 0))


def dict_filter(df: DataFrame, wanted: dict[str, Sequence]) -> DataFrame:
    """AND of IN lists; columns the table lacks are passed over."""
    return df.filter(_all([F.col(c).isin(list(v)) for c, v in wanted.items() if c in df.columns]))


def nuclide_window(
    df: DataFrame, z: int, a: int, energy_range: tuple[float, float] | None = None, mt: int | None = None,
    positive_only: bool = False, projectile: str | None = None,
) -> DataFrame:
    """Rows of one nuclide (optionally one reaction, one window), in energy order."""
    parts = [F.col("Z") == z, F.col("A") == a]
    if mt is not None:
        parts.append(F.col("MT") == mt)
    if projectile is not None:
        parts.append(F.col("Projectile") == projectile)
    if energy_range:
        parts.append(F.col("Energy").between(*energy_range))
    if positive_only:
        parts.append(F.col("CrossSection") > 0)
    return df.filter(_all(parts)).orderBy("Energy", "CrossSection")


def log_plot_rows(
    df: DataFrame, x: str = "Energy", y: str = "CrossSection", x_range: tuple[float, float] | None = None
) -> DataFrame:
    """Rows a log-log plot can show, in x order."""
    kept = df.filter(finite(x) & finite(y) & (F.col(x) > 0) & (F.col(y) > 0))
    if x_range:
        kept = kept.filter(F.col(x).between(*x_range))
    return kept.orderBy(x, y)


def remaining_mask(
    threshold: float, point_outliers: bool = True, discrepant: bool = True, raw: bool = True
) -> Column:
    """Rows left after the chosen exclusions (point outliers, experiments, raw data)."""
    parts = []
    if point_outliers:
        parts.append(_false_if_null(F.col("z_score") <= threshold))
    if discrepant:
        parts.append(~_false_if_null(F.col("experiment_outlier")))
    if raw:
        parts.append(~_false_if_null(F.col("sf8").contains("RAW")))
    return _all(parts)


def with_valid_uncertainty(df: DataFrame, column: str = "Uncertainty") -> DataFrame:
    return df.filter(finite(column) & (F.col(column) > 0))


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns that may enter a model."""
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return [n for n, t in df.dtypes if t in numeric and n not in set(exclude)]


def imputed(c: Column, bound: float = 1e10) -> Column:
    """0 for a missing value, infinities cut to the bound.

    Without ``greatest`` and ``least``: the code generated for a frame of such columns would be too
    long for the JVM to compile, and every row ten times slower.
    """
    known = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return F.when(known > bound, bound).when(known < -bound, -bound).otherwise(known)


def training_rows(
    df: DataFrame, features: Sequence[str], target: str, impute: bool = True, weight: str | None = None
) -> DataFrame:
    """Rows a trainer accepts: features finite (imputed or dropped), target finite, weight set."""
    if impute:
        clean = {c: imputed(F.col(c).cast("double")) for c in features}
        rows = df.withColumns(clean)
    else:
        rows = df.filter(_all([finite(F.col(c).cast("double")) for c in features]))
    rows = rows.filter(finite(F.col(target).cast("double")))
    return rows.filter(F.col(weight).isNotNull()) if weight else rows
