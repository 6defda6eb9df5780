"""All queries of the package: importing the operators registers them."""

from __future__ import annotations

from crossfield.llm import (  # noqa: F401
    adscan, bpe, imatch, line_dedup, mixing, pii, quality_rules, residues, secrets, simhash, suffixes, vptree, warc,
)
from crossfield.llm.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
