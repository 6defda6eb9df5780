"""Point extraction from the table layouts experimental archives come in.

Inputs are DataFrames of the exported tables. Key filters are ordinary predicates on
the metadata side, so Parquet prunes before any join. Ids may own many rows on either side of
a join: ``grid_join`` deals the rows of a hot id to blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.functions.scalars import target_mass_number
from crossfield.plans.scale import grid_join, materialize, rows_per_key
from crossfield.schema import PAYLOAD_SCHEMA

# Optional descriptive columns of the metadata table and the names they get.
DIAGNOSTICS = {"year1": "Year", "author1": "Author", "reatyp": "ReactionType", "ndat": "NDataPoints"}


def _datasets(meta: DataFrame, z_keys: Sequence[int], diagnostics: bool) -> DataFrame:
    """Datasets with a charge, a reaction and a readable mass number."""
    kept = meta.filter(F.col("zTarg1").isNotNull() & F.col("MT").isNotNull())
    if z_keys:
        kept = kept.filter(F.col("zTarg1").isin(list(z_keys)))
    extra = [F.col(c).alias(n) for c, n in DIAGNOSTICS.items() if diagnostics and c in meta.columns]
    out = kept.select(
        "DatasetID", F.col("zTarg1").alias("Z"), target_mass_number("Targ1").alias("A"),
        F.col("Proj").alias("Projectile"), "MT", *extra)
    return out.filter(F.col("A").isNotNull())


def join_datasets(datasets: DataFrame, points: DataFrame, key: str = "DatasetID", unique_ids: bool = False) -> DataFrame:
    """Every dataset row with every point row of its id; a dataset without points goes.

    ``unique_ids``: no id stands twice on either side, so no id can be hot and none is counted.
    """
    return datasets.join(points, key) if unique_ids else grid_join(datasets, points, [key])


def _required(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no data points found")
    return df


def nested_payload_points(
    meta: DataFrame, payload: DataFrame, z_keys: Sequence[int] = (), diagnostics: bool = False,
    require: bool = False, unique_ids: bool = False,
) -> DataFrame:
    """One row per point of each dataset's JSON payload.

    A payload that is no JSON, lacks energies or values, or has none, gives no rows.
    Missing trailing errors are NULL; arrays are cut to the shorter of energies and values
    first, because zipping pads to the longest.
    """
    body = F.from_json("jx5z", PAYLOAD_SCHEMA)["c5data"]
    joined = join_datasets(_datasets(meta, z_keys, diagnostics), payload.select("DatasetID", "jx5z"), unique_ids=unique_ids)
    parsed = joined.withColumn("__b", body).drop("jx5z")
    x, y = F.col("__b.x1.x1"), F.col("__b.y.y")
    n = F.least(F.size(x), F.size(y))

    def cut(array: Column, name: str) -> Column:
        return F.slice(array, F.lit(1), n).alias(name)

    empty = F.array().cast("array<double>")
    zipped = F.arrays_zip(
        cut(x, "En"), cut(F.coalesce(F.col("__b.x1.dx1"), empty), "dEn"),
        cut(y, "Data"), cut(F.coalesce(F.col("__b.y.dy"), empty), "dData"))
    points = parsed.filter(n > 0).select("*", F.inline(zipped)).drop("__b")
    return _required(points) if require else points


def flat_points(
    meta: DataFrame, points: DataFrame, z_keys: Sequence[int] = (), diagnostics: bool = False
) -> DataFrame:
    return join_datasets(_datasets(meta, z_keys, diagnostics), _flat_rows(points))


def _flat_rows(points: DataFrame) -> DataFrame:
    return points.filter(F.col("x1").isNotNull() & F.col("y").isNotNull()).select(
        "DatasetID", F.col("x1").alias("En"), F.col("y").alias("Data"), F.col("dy").alias("dData"))


def flat_point_totals(meta: DataFrame, points: DataFrame, by: Sequence[str], z_keys: Sequence[int] = ()) -> DataFrame:
    """Number of rows and sums of ``flat_points`` per value of the dataset columns ``by``, without all its pairs.

    Metadata rows of an id that agree in ``by`` are counted first; a point meets each such value
    once and counts as often as the value stands there.
    """
    copies = _datasets(meta, z_keys, False).groupBy("DatasetID", *by).agg(F.count(F.lit(1)).alias("__copies"))
    joined = join_datasets(copies, _flat_rows(points))
    return joined.groupBy(*by).agg(
        F.sum("__copies").alias("n"), *[F.sum(F.col("__copies") * F.col(c)).alias(c) for c in ("En", "Data", "dData")])


LEGACY_COLUMNS = ["entry_id", "target_z", "target_a", "reaction_mt", "energy", "xs", "dxs"]


def legacy_points(points: DataFrame, z_keys: Sequence[int] = ()) -> DataFrame:
    rows = points.select(*LEGACY_COLUMNS).filter(F.col("energy").isNotNull() & F.col("xs").isNotNull())
    return rows.filter(F.col("target_z").isin(list(z_keys))) if z_keys else rows


def split_table_points(
    reactions: DataFrame, energies: DataFrame, cross_sections: DataFrame, uncertainties: DataFrame,
    z_keys: Sequence[int] = (),
) -> DataFrame:
    """Reactions with every energy/value pair of the same reaction id.

    Values must exist, so the two value joins are inner; uncertainties stay optional.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("reaction_id", F.col("value").alias(name))

    heads = reactions.select(
        F.col("id").alias("reaction_id"), "entry_id", "target_z", "target_a", F.col("mt").alias("reaction_mt"))
    if z_keys:
        heads = heads.filter(F.col("target_z").isin(list(z_keys)))
    tables = [heads, side(energies, "energy").filter("energy IS NOT NULL"),
              side(cross_sections, "xs").filter("xs IS NOT NULL"), side(uncertainties, "dxs")]
    key = ["reaction_id"]
    sizes = [materialize(rows_per_key(table, key)) for table in tables]
    joined, known = tables[0], sizes[0]
    for table, size, how in zip(tables[1:], sizes[1:], ("inner", "inner", "left"), strict=True):
        joined = grid_join(joined, table, key, how, left_counts=known, right_counts=size)
        # An id of a rows and b rows has a * b afterwards: no joined table is counted.
        times = F.col("rows") * F.coalesce("more", F.lit(1))
        known = known.join(size.withColumnRenamed("rows", "more"), key, how).select(*key, times.alias("rows"))
    return joined.select(*LEGACY_COLUMNS)


def extract_points(
    tables: Mapping[str, DataFrame], z_keys: Sequence[int] = (), diagnostics: bool = False
) -> DataFrame:
    """Choose the layout by the tables present; otherwise the first table that looks right."""
    if {"x4pro_ds", "x4pro_x5z"} <= set(tables):
        return nested_payload_points(tables["x4pro_ds"], tables["x4pro_x5z"], z_keys, diagnostics)
    if {"x4pro_ds", "x4pro_c5dat"} <= set(tables) and not tables["x4pro_c5dat"].isEmpty():
        return flat_points(tables["x4pro_ds"], tables["x4pro_c5dat"], z_keys, diagnostics)
    if "data_points" in tables:
        return legacy_points(tables["data_points"], z_keys)
    if "reactions" in tables:
        return split_table_points(
            tables["reactions"], tables["energies"], tables["cross_sections"], tables["uncertainties"], z_keys)
    for df in tables.values():
        names = [c.lower() for c in df.columns]
        wanted = (("energy",), ("xs", "cross"), ("z", "target"))
        if all(any(part in name for name in names for part in parts) for parts in wanted):
            return df
    raise ValueError("no table holds energies, cross sections and targets")


def spread_payload(points: DataFrame, key: str, x: str, dx: str, y: str, dy: str) -> DataFrame:
    """Payload table of a point table: the inverse of the nested scan.

    One payload holds one dataset. Datasets larger than a payload may be are written in
    numbered parts by the caller (part of the key), never gathered whole.
    """
    row = F.struct(F.col(x).alias("x"), F.col(dx).alias("dx"), F.col(y).alias("y"), F.col(dy).alias("dy"))
    gathered = points.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("r"))
    body = F.struct(F.struct(
        F.struct(F.col("r.x").alias("x1"), F.col("r.dx").alias("dx1")).alias("x1"),
        F.struct(F.col("r.y").alias("y"), F.col("r.dy").alias("dy")).alias("y"),
    ).alias("c5data"))
    return gathered.select(F.col(key).alias("DatasetID"), F.to_json(body, {"ignoreNullFields": "false"}).alias("jx5z"))
