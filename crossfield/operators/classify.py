"""Reaction metadata: field extraction, clean-up, purity flags, superseded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions.scalars import id_prefix, reaction_fields
from crossfield.plans.scale import attach, checked_broadcast, materialize

SF_COLUMNS = ["sf5", "sf6", "sf8", "sf9"]
FLAGS = [
    "is_relative", "is_averaged", "is_other_modified", "is_ratio",
    "is_partial", "is_non_xs", "is_non_experimental",
]


def has_token(sf8: Column | str, codes: list[str]) -> Column:
    """Whether any slash-separated token of a compound code is in ``codes``."""
    sf8 = F.col(sf8) if isinstance(sf8, str) else sf8
    tokens = F.split(sf8, "/")
    return F.coalesce(F.arrays_overlap(tokens, F.array(*[F.lit(c) for c in codes])), F.lit(False))


def _listed(c: Column, codes: list[str]) -> Column:
    return F.coalesce(c.isin(codes), F.lit(False))


def clean_sf(df: DataFrame) -> DataFrame:
    """Trim and upper-case the code columns; words that mean nothing become NULL."""
    def cleaned(name: str) -> Column:
        code = F.upper(F.trim(F.col(name)))
        return F.when(~code.isin(K.NULL_WORDS), code)
    return df.withColumns({c: cleaned(c) for c in SF_COLUMNS if c in df.columns})


def metadata_projection(codes: DataFrame) -> DataFrame:
    """DatasetID and code columns of a reaction-code table.

    Separate code columns are used where the table has them. Otherwise they are read out
    of the full reaction text, except for compound reactions, whose text has no single
    set of fields; a ratio is marked as such.
    """
    lower = {c.lower(): c for c in codes.columns}
    key = next(lower[k] for k in ("reacodeid", "datasetid", "id") if k in lower)
    full = next((lower[k] for k in ("fullcode", "reacode", "full_code", "code") if k in lower), None)
    combined = next((lower[k] for k in ("reaccombi", "reac_combi", "reactioncombi") if k in lower), None)
    present = {c: lower[c] for c in SF_COLUMNS if c in lower}
    out = {"DatasetID": F.col(key)}
    if present:
        out |= {c: F.col(present[c]) if c in present else F.lit(None).cast("string") for c in SF_COLUMNS}
    elif full:
        parsed = reaction_fields(full)
        if combined:
            mark = F.coalesce(F.col(combined), F.lit(""))
            simple = ~mark.rlike("[/+]")
            parsed = {c: F.when(simple, e) for c, e in parsed.items()}
            parsed["sf6"] = F.when(mark.contains("/"), "SIG/RAT").otherwise(parsed["sf6"])
        out |= parsed
    if full:
        out["FullCode"] = F.col(full)
    if combined:
        out["reacCombi"] = F.col(combined)
    return codes.select(*[e.alias(name) for name, e in out.items()])


def classification_flags() -> dict[str, Column]:
    sf5, sf6, sf9 = F.col("sf5"), F.col("sf6"), F.col("sf9")
    return {
        "is_relative": has_token("sf8", K.SF8_RELATIVE),
        "is_averaged": has_token("sf8", K.SF8_AVERAGED),
        "is_other_modified": has_token("sf8", K.SF8_OTHER),
        "is_ratio": F.coalesce(sf6.contains("RAT"), F.lit(False)),
        "is_partial": _listed(sf5, K.SF5_PARTIAL),
        "is_non_xs": F.coalesce(~sf6.isin(K.SF6_ACCEPTED), F.lit(False)),
        "is_non_experimental": _listed(sf9, K.SF9_NOT_MEASURED),
    }


def classify(df: DataFrame) -> DataFrame:
    """Flags, ``is_pure`` and the priority label ``data_type`` from clean code columns."""
    flagged = df.withColumns(classification_flags())
    impure = F.col(FLAGS[0])
    for name in FLAGS[1:]:
        impure = impure | F.col(name)
    label = (
        F.when(F.col("is_non_experimental"), "calculated")
        .when(F.col("is_relative"), "relative")
        .when(F.col("is_ratio"), "ratio")
        .when(F.col("is_averaged"), "averaged")
        .when(F.col("is_non_xs"), "non_xs")
        .when(F.col("is_partial"), "partial")
        .when(~impure, "absolute")
        .otherwise("other_modified")
    )
    return flagged.withColumns({"is_pure": ~impure, "data_type": label})


def without_metadata(df: DataFrame) -> DataFrame:
    """The same columns when no reaction codes exist: everything counts as pure."""
    null = F.lit(None).cast("string")
    return df.withColumns({
        **{c: null for c in SF_COLUMNS}, "is_pure": F.lit(True), "data_type": F.lit("unknown"),
    })


def join_metadata(points: DataFrame, metadata: DataFrame, key: str = "DatasetID") -> DataFrame:
    """Left join of reaction codes; one code row per dataset keeps the row count."""
    wanted = [c for c in [*SF_COLUMNS, "FullCode"] if c in metadata.columns]
    unique = metadata.select(F.col("DatasetID").alias(key), *wanted).groupBy(key).agg(
        F.min_by(F.struct(*wanted), F.struct(*wanted)).alias("__m")).select(key, "__m.*")
    return attach(points, unique, [key])


def superseded_ids(status: DataFrame, flag: str = "SPSDD", key: str = "SubentID") -> DataFrame:
    return status.filter(F.col(flag).isin(K.SUPERSEDED_FLAGS)).select(F.col(key).alias("__superseded")).distinct()


def drop_superseded(df: DataFrame, status: DataFrame, key: str = "DatasetID") -> DataFrame:
    """Anti join on the first eight characters of the identifier."""
    ids = checked_broadcast(materialize(superseded_ids(status)))
    return df.join(ids, id_prefix(key) == F.col("__superseded"), "left_anti")


def keep_pure(df: DataFrame, exclude_non_pure: bool = True, keep_metadata: bool = True) -> DataFrame:
    kept = df.filter("is_pure") if exclude_non_pure else df
    kept = kept.drop(*FLAGS)
    return kept if keep_metadata else kept.drop(*SF_COLUMNS, "is_pure", "data_type")


def enrich_and_filter(
    points: DataFrame,
    codes: DataFrame | None = None,
    status: DataFrame | None = None,
    key: str = "DatasetID",
    exclude_non_pure: bool = True,
    keep_metadata: bool = True,
) -> DataFrame:
    """Superseded removal, code join, clean-up, classification and purity filter."""
    rows = drop_superseded(points, status, key) if status is not None else points
    if codes is None:
        return without_metadata(rows) if keep_metadata else rows
    joined = join_metadata(rows, metadata_projection(codes), key)
    return keep_pure(classify(clean_sf(joined)), exclude_non_pure, keep_metadata)
