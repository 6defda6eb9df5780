"""Nuclide reference tables in fixed-width and whitespace layouts.

Each parser takes a DataFrame of text lines (column ``value``) as ``spark.read.text``
gives it, and is a projection plus a filter: no Python per line. Lines may be computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.functions.scalars import half_life_seconds, spin_parity

_LINE = "value"
# First character and width (0-based start) of the mass-table fields.
MASS_FIELDS = {"N": (4, 5), "Z": (9, 5), "A": (14, 5), "mass": (28, 14), "binding": (54, 13)}
# Value columns of the two reaction-energy tables, in file order.
REACTION_ENERGY_1 = ["S_2n_keV", "S_2p_keV", "Q_alpha_keV", "Q_2beta_minus_keV", "Q_ep_keV", "Q_beta_n_keV"]
REACTION_ENERGY_2 = ["S_1n_keV", "S_1p_keV", "Q_4beta_minus_keV", "Q_d_alpha_keV", "Q_p_alpha_keV", "Q_n_alpha_keV"]
# Words that mark header lines.
HEADER_WORDS = ["ATOMIC", "A =", "****", "format", "Warnings", "cc", "....+"]
REACTION_HEADER_WORDS = [*HEADER_WORDS, "LINEAR"]


def _slice(start: int, width: int) -> Column:
    return F.trim(F.substring(F.col(_LINE), start + 1, width))


def _length() -> Column:
    """Characters of a line; its line end counts, as field limits include it."""
    return F.length(_LINE) + 1


def _once(lines: DataFrame) -> DataFrame:
    """The lines, each computed once however many rules and fields read it.

    A column of a projection is put in place of its uses, so a computed line would be made
    again for every rule; one that a generator gives is not.
    """
    return lines.select(F.explode(F.array(_LINE)).alias(_LINE))


def _data_lines(lines: DataFrame, shortest: int, header_words: list[str]) -> DataFrame:
    """Lines long enough to hold the fields that are neither page breaks nor headers."""
    body = _once(lines).filter((_length() >= shortest) & (F.substring(_LINE, 1, 1) != "1"))
    for word in header_words:
        body = body.filter(~F.contains(F.col(_LINE), F.lit(word)))
    return body


def _number(text: Column) -> Column:
    """A value whose estimated decimal point may be a hash sign."""
    return F.translate(text, "#*", ".").try_cast("double")


def _whole(start: int, width: int) -> Column:
    return _slice(start, width).try_cast("int")


def mass_table(lines: DataFrame) -> DataFrame:
    f = MASS_FIELDS
    binding = _slice(*f["binding"])
    body = _data_lines(lines, 67, HEADER_WORDS).filter(
        (binding == "") | _number(binding).isNotNull())
    out = body.select(
        _whole(*f["Z"]).alias("Z"), _whole(*f["A"]).alias("A"), _whole(*f["N"]).alias("N"),
        _number(_slice(*f["mass"])).alias("Mass_Excess_keV"),
        _number(binding).alias("Binding_Energy_keV"))
    return out.dropna(subset=["Z", "A", "N", "Mass_Excess_keV"]).withColumn(
        "Binding_Per_Nucleon_keV", F.when(F.col("A") > 0, F.col("Binding_Energy_keV") / F.col("A")))


def reaction_energy_table(lines: DataFrame, names: list[str]) -> DataFrame:
    """A at 1..3, Z at 8..10, then six value/error pairs of 22 characters from 12 on."""
    body = _data_lines(lines, 50, REACTION_HEADER_WORDS)
    values = [
        F.when(_length() >= 12 + 22 * i + 12, _number(_slice(12 + 22 * i, 12))).alias(name)
        for i, name in enumerate(names)
    ]
    return body.select(_whole(8, 3).alias("Z"), _whole(1, 3).alias("A"), *values).dropna(subset=["Z", "A"])


def structure_table(lines: DataFrame) -> DataFrame:
    """Spin, parity, isomer level and half-life per nuclide state."""
    body = _once(lines).filter((_length() >= 102) & ~F.col(_LINE).startswith("#"))
    code = _slice(4, 4)
    spin, parity = spin_parity(_slice(88, 14))
    return body.filter(F.length(code) >= 3).select(
        F.substring(code, 1, 3).try_cast("int").alias("Z"), _whole(0, 3).alias("A"),
        spin.alias("Spin"), parity.alias("Parity"),
        F.coalesce(F.substring(code, 4, 1).try_cast("int"), F.lit(0)).alias("Isomer_Level"),
        half_life_seconds(_slice(69, 9), _slice(78, 2)).alias("Half_Life_s"),
    ).dropna(subset=["Z", "A"])


def whitespace_mass_table(lines: DataFrame) -> DataFrame:
    """Loose variant: at least nine words, of which five are read."""
    words = F.split(F.trim(F.col(_LINE)), r"\s+")
    body = _once(lines).filter(~F.col(_LINE).startswith("#")).select(F.explode(F.array(words)).alias("w")).filter(F.size("w") >= 9)

    def word(i: int, kind: str) -> Column:
        return F.get("w", F.lit(i)).try_cast(kind)

    return body.select(
        word(2, "int").alias("Z"), word(3, "int").alias("A"), word(1, "int").alias("N"),
        word(5, "double").alias("Mass_Excess_keV"), word(7, "double").alias("Binding_Energy_keV"),
    ).dropna()


def clean_placeholders(lines: DataFrame) -> DataFrame:
    return lines.select(F.translate(_LINE, "#", ".").alias(_LINE))


def placeholder_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(F.regexp_count(_LINE, F.lit("#"))), F.lit(0)).alias("replacements"))
