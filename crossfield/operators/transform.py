"""Reversible scaling and log transforms with a fitted state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfield.functions import scalars as S
from crossfield.operators.select import feature_columns
from crossfield.plans.quantiles import column_percentiles
from crossfield.sources.tables import load_json, save_json

SCALERS = ("minmax", "standard", "robust", "none")
OVERFLOW = 1e10


@dataclass
class TransformConfig:
    log_target: bool = True
    target_epsilon: float = 1e-10
    log_base: int | str = 10
    log_energy: bool = True
    energy_log_base: int | str = 10
    scaler: str = "minmax"
    scale_columns: str | list[str] | None = "all"

    def __post_init__(self) -> None:
        if self.scaler not in SCALERS:
            raise ValueError(f"scaler must be one of {SCALERS}")
        for base in (self.log_base, self.energy_log_base):
            if base not in S.LOG_BASES:
                raise ValueError(f"log base must be one of {S.LOG_BASES}")
        if self.target_epsilon <= 0:
            raise ValueError("target_epsilon must be positive")


@dataclass
class Scaler:
    """Log-energy first, then (x - shift) / scale per column."""

    config: TransformConfig = field(default_factory=TransformConfig)
    shift: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    fitted: bool = False

    # -- fit
    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> Scaler:
        if columns is None:
            chosen = self.config.scale_columns
            columns = feature_columns(df, []) if chosen in (None, "all") else list(chosen)
        self.shift, self.scale = {}, {}
        if self.config.scaler != "none":
            row = scaler_statistics(self._logged(df), columns, self.config.scaler).first()
            for c in columns:
                self.shift[c], self.scale[c] = row[f"{c}__shift"], row[f"{c}__scale"]
        self.fitted = True
        return self

    def _logged(self, df: DataFrame) -> DataFrame:
        if not self.config.log_energy or "Energy" not in df.columns:
            return df
        return df.withColumn("Energy", S.log_base("Energy", self.config.energy_log_base))

    def _require_fit(self) -> None:
        if not self.fitted:
            raise RuntimeError("fit the scaler first")

    # -- features
    def transform(self, df: DataFrame, energy: str | None = None) -> DataFrame:
        """Scaled columns; ``energy`` names an energy column when there is no ``Energy``,
        and its logarithm is then added as ``Energy_log``."""
        self._require_fit()
        out = self._logged(df)
        if self.config.log_energy and "Energy" not in df.columns and energy:
            out = out.withColumn("Energy_log", S.log_base(energy, self.config.energy_log_base))
        return out.withColumns({c: self._scaled(c) for c in self.shift})

    def _scaled(self, name: str) -> Column:
        value = (F.col(name).cast("double") - F.lit(self.shift[name])) / F.lit(self.scale[name])
        infinite = F.abs(value) == float("inf")
        return F.when(infinite, F.signum(value) * OVERFLOW).otherwise(value)

    def fit_transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def inverse(self, df: DataFrame) -> DataFrame:
        """Unscale every column, then undo the logarithm of the unscaled energy."""
        self._require_fit()
        out = df.withColumns({
            c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.shift[c]) for c in self.shift})
        if not self.config.log_energy:
            return out
        if "Energy" in out.columns:
            return out.withColumn("Energy", S.power_base("Energy", self.config.energy_log_base))
        if "Energy_log" in out.columns:
            return out.withColumn("Energy", S.power_base("Energy_log", self.config.energy_log_base)).drop("Energy_log")
        return out

    # -- target
    def target(self, column: Column | str) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return S.log_target(c, self.config.log_base, self.config.target_epsilon) if self.config.log_target else c

    def inverse_target(self, column: Column | str) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return S.unlog_target(c, self.config.log_base, self.config.target_epsilon) if self.config.log_target else c

    # -- state
    def params(self) -> dict[str, Any]:
        return {"config": asdict(self.config), "shift": self.shift, "scale": self.scale, "fitted": self.fitted}

    @classmethod
    def from_params(cls, params: dict[str, Any]) -> Scaler:
        return cls(TransformConfig(**params["config"]), params["shift"], params["scale"], params["fitted"])

    def save(self, spark: SparkSession, path: str) -> None:
        self._require_fit()
        save_json(spark, path, self.params())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        return cls.from_params(load_json(spark, path))


def scaler_statistics(df: DataFrame, columns: Sequence[str], scaler: str) -> DataFrame:
    """One row with ``<column>__shift`` and ``<column>__scale``; NULL and NaN are ignored.

    A column without values gets shift 0 and scale 1, one without spread scale 1.
    """
    def clean(c: str) -> Column:
        return S.nan_to_null(F.col(c).cast("double"))

    def settled(c: str, shift: Column, spread: Column) -> list[Column]:
        scale = F.when(spread.isNull() | (spread == 0), 1.0).otherwise(spread)
        return [F.coalesce(shift, F.lit(0.0)).alias(f"{c}__shift"), scale.alias(f"{c}__scale")]

    if scaler == "standard":
        return df.agg(*[e for c in columns for e in settled(c, F.avg(clean(c)), F.stddev_pop(clean(c)))])
    if scaler == "minmax":
        return df.agg(*[
            e for c in columns for e in settled(c, F.min(clean(c)), F.max(clean(c)) - F.min(clean(c)))])
    if scaler == "robust":
        found = column_percentiles(df, {c: clean(c) for c in columns}, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
        quartile = {(c, q): F.col(f"`{c}__{q}`") for c in columns for q in ("q1", "q2", "q3")}
        return found.select(*[
            e for c in columns for e in settled(c, quartile[c, "q2"], quartile[c, "q3"] - quartile[c, "q1"])])
    raise ValueError(f"no statistics for scaler {scaler!r}")
