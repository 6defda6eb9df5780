"""Column expressions: physics, parsing and log-space helpers. All stay in codegen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossfield import constants as K

LOG_BASES = (10, "e", 2)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_ranges(c: Column | str, ranges: list[tuple[int, int]]) -> Column:
    """Membership in any of the inclusive integer ranges."""
    c = _col(c)
    return reduce(lambda a, b: a | b, [c == lo if lo == hi else c.between(lo, hi) for lo, hi in ranges])


# ------------------------------------------------------------------ numbers
def finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def log_base(c: Column | str, base: int | str = 10) -> Column:
    c = _col(c)
    if base == 10:
        return F.log10(c)
    if base == 2:
        return F.log2(c)
    if base == "e":
        return F.log(c)
    raise ValueError(f"log base must be one of {LOG_BASES}, got {base!r}")


def power_base(c: Column | str, base: int | str = 10) -> Column:
    c = _col(c)
    if base == "e":
        return F.exp(c)
    if base in (10, 2):
        return F.pow(F.lit(float(base)), c)
    raise ValueError(f"log base must be one of {LOG_BASES}, got {base!r}")


def log_target(c: Column | str, base: int | str = 10, epsilon: float = 1e-10) -> Column:
    return log_base(_col(c) + F.lit(epsilon), base)


def unlog_target(c: Column | str, base: int | str = 10, epsilon: float = 1e-10) -> Column:
    return F.greatest(power_base(c, base) - F.lit(epsilon), F.lit(0.0))


def clipped_log10(c: Column | str, floor: float = 1e-30) -> Column:
    return F.log10(F.greatest(_col(c), F.lit(floor)))


def log_uncertainty(unc: Column | str, value: Column | str) -> Column:
    """Absolute uncertainty carried into log10 space: unc / (value ln 10)."""
    return _col(unc) / (_col(value) * F.lit(math.log(10.0)))


def log_error_bars(value: Column | str, unc: Column | str, cap: float = 2.0) -> tuple[Column, Column]:
    """Upper and lower error bar of log10(value), each within [0, cap]."""
    value, unc = _col(value), _col(unc)
    centre = clipped_log10(value)

    def capped(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(cap))

    up = capped(clipped_log10(value + unc) - centre)
    down = capped(F.when(value > unc, centre - F.log10(value - unc)).otherwise(F.lit(cap)))
    return up, down


# ---------------------------------------------------------------- reactions
def particle_vector(mt: Column | str) -> dict[str, Column]:
    """The nine emission numbers of a reaction number, as one expression each."""
    mt = _col(mt)
    out = {}
    for name in K.PARTICLE_COLUMNS:
        by_number: dict[int, list[tuple[int, int]]] = {}
        for span, emitted in K.PARTICLE_EMISSION:
            if name in emitted:
                by_number.setdefault(emitted[name], []).append(span)
        branches = [(in_ranges(mt, spans), n) for n, spans in by_number.items()]
        expr = reduce(lambda acc, b: acc.when(b[0], b[1]), branches[1:], F.when(*branches[0])).otherwise(0)
        out[name] = expr.cast("float" if name == "out_n" else "int")
    return out


def charge_conserved(z_in: Column, z_out: Column, z_emitted: Column) -> Column:
    return _col(z_in) == _col(z_out) + _col(z_emitted)


def mass_conserved(a_in: Column, a_out: Column, a_emitted: Column) -> Column:
    return _col(a_in) + 1 == _col(a_out) + _col(a_emitted)


# ----------------------------------------------------------------- nuclides
def radius_fm(a: Column | str) -> Column:
    return F.lit(K.RADIUS_FM) * F.pow(_col(a).cast("double"), F.lit(1.0 / 3.0))


def k_times_radius(energy: Column | str, a: Column | str) -> Column:
    return F.lit(K.WAVE_NUMBER) * F.sqrt(_col(energy) / F.lit(1e6)) * radius_fm(a)


def _magic_distances(n: Column) -> Column:
    return F.array(*[F.struct(F.abs(n - m).alias("d"), F.lit(m).alias("m")) for m in K.MAGIC_NUMBERS])


def valence(n: Column | str) -> Column:
    """Distance to the nearest magic number."""
    n = _col(n)
    return F.least(*[F.abs(n - m) for m in K.MAGIC_NUMBERS])


def shell_closure(n: Column | str) -> Column:
    """Nearest magic number; a tie goes to the smaller one."""
    return F.array_min(_magic_distances(_col(n)))["m"]


def promiscuity(valence_n: Column, valence_p: Column) -> Column:
    total = valence_n + valence_p
    return F.when(total == 0, F.lit(0.0)).otherwise(valence_n * valence_p / total)


def half_life_log10(seconds: Column | str) -> Column:
    """log10 of a half-life; zero counts as 1e-30 s and infinity as stable."""
    s = _col(seconds)
    bounded = F.when(F.abs(s) == float("inf"), F.lit(K.STABLE_HALF_LIFE_S)).otherwise(s)
    return F.log10(F.greatest(bounded, F.lit(1e-30)))


def binding_energy_mev(z: Column | str, a: Column | str) -> Column:
    """Semi-empirical binding energy in MeV."""
    z, a = _col(z).cast("double"), _col(a).cast("double")
    n = a - z
    pairing = (
        F.when((F.pmod(n, F.lit(2.0)) == 0) & (F.pmod(z, F.lit(2.0)) == 0), K.SEMF_PAIRING / F.sqrt(a))
        .when((F.pmod(n, F.lit(2.0)) == 1) & (F.pmod(z, F.lit(2.0)) == 1), -K.SEMF_PAIRING / F.sqrt(a))
        .otherwise(0.0)
    )
    return (
        K.SEMF_VOLUME * a
        - K.SEMF_SURFACE * F.pow(a, F.lit(2.0 / 3.0))
        - K.SEMF_COULOMB * z * z / F.pow(a, F.lit(1.0 / 3.0))
        - K.SEMF_ASYMMETRY * (n - z) * (n - z) / a
        + pairing
    )


def mass_excess_kev(z: Column | str, a: Column | str) -> Column:
    return -binding_energy_mev(z, a) * 1000.0


# ------------------------------------------------------------------ parsing
def target_mass_number(target: Column | str) -> Column:
    """Mass number after the first dash-digits of a target such as ``U-235``."""
    return F.nullif(F.regexp_extract(_col(target), r"-(\d+)", 1), F.lit("")).cast("int")


def id_prefix(identifier: Column | str) -> Column:
    return F.substring(_col(identifier).cast("string"), 1, 8)


def _code_field(code: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(code, pattern, 1)), F.lit(""))


def _tail_field(code: Column, position: int) -> Column:
    tail = F.when(F.instr(code, ")") > 0, F.substring_index(code, ")", -1))
    return F.nullif(F.trim(F.get(F.split(tail, ","), F.lit(position))), F.lit(""))


def reaction_fields(code: Column | str) -> dict[str, Column]:
    """Branch, quantity, modifier and data type out of ``T(P,X)R,sf5,sf6,sf7,sf8,sf9``."""
    code = _col(code)
    return {
        "sf5": _code_field(code, r"\)[^,]*,([^,]*),"),
        "sf6": _code_field(code, r"\)[^,]*,[^,]*,([^,)]+)"),
        "sf8": _tail_field(code, 4),
        "sf9": _tail_field(code, 5),
    }


def spin_parity(text: Column | str) -> tuple[Column, Column]:
    """Spin and parity of a J-pi text such as ``(5/2+)*``; isospin entries give NULL."""
    bare = F.trim(F.translate(_col(text), "*#()", ""))
    usable = F.when((bare != "") & (F.instr(bare, "T=") == 0), bare)
    parity = F.when(F.instr(usable, "+") > 0, 1).when(F.instr(usable, "-") > 0, -1)
    number = F.trim(
        F.when(F.instr(usable, "+") > 0, F.translate(usable, "+", "")).otherwise(F.translate(usable, "-", ""))
    )
    halves = F.split(number, "/")
    fraction = F.try_divide(F.get(halves, F.lit(0)).try_cast("double"), F.get(halves, F.lit(1)).try_cast("double"))
    spin = F.when(F.size(halves) == 2, fraction).when(
        number.rlike(r"^\d*\.?\d+\.?$"), number.try_cast("double"))
    return spin, parity


def half_life_seconds(value: Column | str, unit: Column | str) -> Column:
    value, unit = F.trim(_col(value)), F.trim(_col(unit))
    number = F.trim(F.translate(value, "#", "")).try_cast("double")
    factors = F.create_map(*[F.lit(x) for pair in K.HALF_LIFE_UNITS.items() for x in pair])
    return (
        F.when(F.contains(value, F.lit("stbl")) | F.contains(value, F.lit("stable")), K.STABLE_HALF_LIFE_S)
        .when(F.contains(value, F.lit("p-unst")), 0.0)
        .otherwise(number * F.try_element_at(factors, unit))
    )
