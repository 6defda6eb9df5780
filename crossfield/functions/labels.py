"""Names for reactions, nuclides and projectiles as lookup expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions.scalars import _col, in_ranges


def _lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def mt_name(mt: Column | str, include_code: bool = False) -> Column:
    mt = _col(mt).cast("int")
    known = _lookup(K.MT_NAMES, mt)
    if include_code:
        known = F.concat(F.lit("MT "), mt.cast("string"), F.lit(": "), known)
    return F.coalesce(known, F.concat(F.lit("Unknown (MT "), mt.cast("string"), F.lit(")")))


def mt_category(mt: Column | str) -> Column:
    branches = [(in_ranges(mt, spans), name) for name, spans in K.MT_CATEGORIES]
    return reduce(lambda acc, b: acc.when(b[0], b[1]), branches[1:], F.when(*branches[0])).otherwise("Other")


def element_symbol(z: Column | str) -> Column:
    z = _col(z).cast("int")
    known = _lookup({i + 1: s for i, s in enumerate(K.ELEMENT_SYMBOLS)}, z)
    return F.coalesce(known, F.concat(F.lit("Z"), z.cast("string")))


def nuclide_label(z: Column | str, a: Column | str) -> Column:
    return F.concat_ws("-", element_symbol(z), _col(a).cast("string"))


def projectile_name(projectile: Column | str) -> Column:
    p = _col(projectile)
    return F.coalesce(_lookup(K.PROJECTILE_NAMES, F.lower(p)), p)


def parse_nuclide(text: Column | str) -> dict[str, Column]:
    """Z, A and symbol of ``U-235``, ``U235`` or ``235U``; NULLs when unreadable."""
    text = _col(text)
    first, second = r"^([A-Z][a-z]?)-?(\d+)$", r"^(\d+)([A-Z][a-z]?)$"
    symbol = F.when(text.rlike(first), F.regexp_extract(text, first, 1)).when(
        text.rlike(second), F.regexp_extract(text, second, 2))
    mass = F.when(text.rlike(first), F.regexp_extract(text, first, 2)).when(
        text.rlike(second), F.regexp_extract(text, second, 1))
    z = _lookup({s: i + 1 for i, s in enumerate(K.ELEMENT_SYMBOLS)}, symbol)
    return {
        "Z": z,
        "A": F.when(z.isNotNull(), mass.try_cast("int")),
        "symbol": F.when(z.isNotNull(), symbol),
    }
