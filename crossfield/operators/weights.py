"""Training weights from reported uncertainties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.functions.scalars import finite, log_uncertainty
from crossfield.plans.quantiles import column_percentiles, table_percentiles

MISSING = ("median", "equal", "exclude")
CLIP_SHARE = 0.99


def raw_weight(unc: str, value: str, log_space: bool) -> tuple[Column, Column]:
    """Inverse variance and whether the row has one of its own.

    In log space a row needs both an uncertainty and a positive value; with an uncertainty
    alone it is treated as missing.
    """
    u, v = F.col(unc), F.col(value)
    valid = finite(unc) & (u > 0)
    if log_space:
        valid = valid & finite(value) & (v > 0)
        sigma = log_uncertainty(u, v)
    else:
        sigma = u
    return F.when(valid, 1.0 / (sigma * sigma)), valid


def add_sample_weights(
    df: DataFrame,
    mode: str | None = "xs",
    missing: str = "median",
    log_target: bool = False,
    log_energy: bool = False,
    uncertainty: str = "Uncertainty",
    energy_uncertainty: str = "Energy_Uncertainty",
    target: str = "CrossSection",
    energy: str = "Energy",
    output: str = "weight",
) -> DataFrame:
    """Add weights of mean 1, clipped at their 99th percentile.

    ``mode`` is None (no weights), ``xs`` or ``both`` (times the energy weight). A kind of
    uncertainty that no row has is left out; without any, ``output`` is NULL.
    """
    if mode not in (None, "xs", "both"):
        raise ValueError("mode must be None, 'xs' or 'both'")
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    null = F.lit(None).cast("double")
    if mode is None or uncertainty not in df.columns:
        return df.withColumn(output, null)
    kinds = {"__xs": (uncertainty, target, log_target and target in df.columns)}
    if mode == "both" and energy_uncertainty in df.columns:
        kinds["__en"] = (energy_uncertainty, energy, log_energy and energy in df.columns)
    seen = _valid_rows(df, kinds)
    used = {}
    for name, (unc, value, logged) in kinds.items():
        # Without a single positive value the log-space variance exists nowhere: stay raw.
        logged = logged and seen[f"{name}_log"] > 0
        if seen[name]:
            used[name] = (raw_weight(unc, value, logged)[0], seen[f"{name}_log" if logged else name])
    if "__xs" not in used:
        return df.withColumn(output, null)
    rows = seen["rows"]
    fill = _fillers(df, used, missing) if any(n < rows for _, n in used.values()) else {}
    combined = reduce(lambda a, b: a * b, [
        F.coalesce(raw, F.lit(fill[name])) if name in fill else raw for name, (raw, _) in used.items()])
    filled = missing != "exclude"
    alone = rows if filled else next(iter(used.values()))[1] if len(used) == 1 else None
    return _normalized(df.withColumn(output, combined), output, alone)


def _valid_rows(df: DataFrame, kinds: dict[str, tuple[str, str, bool]]) -> dict[str, int]:
    """Rows with a weight of their own, raw and in log space, of every kind: one scan."""
    counts = [F.count(F.lit(1)).alias("rows")]
    for name, (unc, value, logged) in kinds.items():
        counts.append(F.count_if(raw_weight(unc, value, False)[1]).alias(name))
        counts.append((F.count_if(raw_weight(unc, value, True)[1]) if logged else F.lit(0)).alias(f"{name}_log"))
    return df.agg(*counts).first().asDict()


def _fillers(df: DataFrame, used: dict[str, tuple[Column, int]], missing: str) -> dict[str, float]:
    """What a row without a weight of its own gets, for every kind: one scan for the medians."""
    if missing == "exclude":
        return {}
    if missing == "equal":
        return dict.fromkeys(used, 1.0)
    found = column_percentiles(
        df, {name: raw for name, (raw, _) in used.items()}, {"median": 0.5}, counts={name: n for name, (_, n) in used.items()}).first()
    return {name: found[f"{name}__median"] for name in used}


def _normalized(df: DataFrame, weight: str, rows: int | None) -> DataFrame:
    """Clip at the 99th percentile, divide by the mean; two numbers come to the driver."""
    cap = table_percentiles(df, weight, {"cap": CLIP_SHARE}, rows=rows).agg(F.max("cap")).first()[0]
    capped = F.when(F.col(weight).isNotNull(), F.least(F.col(weight), F.lit(cap).cast("double")))
    mean = df.agg(F.avg(capped)).first()[0]
    return df.withColumn(weight, capped / F.lit(mean) if mean is not None and mean > 0 else capped)
