"""Nuclides as nodes and reactions as edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield import constants as K
from crossfield.functions.scalars import finite, mass_excess_kev
from crossfield.plans.scale import attach, checked_broadcast, materialize

NODE = ["Z", "A"]
# Change of the mass number per reaction that leads to a neighbouring nuclide.
MASS_STEPS = {2: 0, 16: -1, 102: 1}
GRID_DECADES, GRID_POINTS = 7.0, 100


def node_index(df: DataFrame) -> DataFrame:
    """Distinct nuclides, numbered in (Z, A) order.

    The number of nuclides is bounded by physics (a few thousand), not by the rows.
    """
    from pyspark.sql.window import Window

    nuclides = df.select(*NODE).distinct().withColumn("N", F.col("A") - F.col("Z"))
    return nuclides.withColumn("node", (F.row_number().over(Window.orderBy("Z", "A")) - 1).cast("int"))


def node_features(df: DataFrame, masses: DataFrame | None = None) -> DataFrame:
    """Eight scaled features per node; a missing mass takes the formula value."""
    nodes = node_index(df)
    if masses is not None:
        nodes = attach(nodes, masses.select(*NODE, "Mass_Excess_keV", "Binding_Energy_keV").dropDuplicates(NODE), NODE)
    else:
        null = F.lit(None).cast("double")
        nodes = nodes.withColumns({"Mass_Excess_keV": null, "Binding_Energy_keV": null})
    mass = F.coalesce("Mass_Excess_keV", mass_excess_kev("Z", "A"))
    fissile = F.lit(False)
    for z, a in K.FISSILE_NUCLIDES:
        fissile = fissile | ((F.col("Z") == z) & (F.col("A") == a))
    stable = (F.abs(F.col("N") - F.col("Z")) < 5) & (F.col("Z") < 83)
    return nodes.select(
        "node", "Z", "A", "N",
        (F.col("Z") / 100.0).alias("z_scaled"), (F.col("A") / 250.0).alias("a_scaled"), (F.col("N") / 150.0).alias("n_scaled"),
        F.when(F.col("Z") > 0, F.col("N") / F.col("Z")).otherwise(0.0).alias("n_over_z"),
        (mass / 1e6).alias("mass_scaled"), (F.coalesce("Binding_Energy_keV", -mass) / 1e6).alias("binding_scaled"),
        fissile.cast("double").alias("is_fissile"), stable.cast("double").alias("is_stable"))


def _edge_features(df: DataFrame) -> list[Column]:
    def optional(name: str, scale: float) -> Column:
        return (F.col(name) / scale) if name in df.columns else F.lit(None).cast("double")

    return [
        (F.col("MT") / 100.0).alias("mt_scaled"), optional("Q_Value", 1e8).alias("q_scaled"),
        optional("Threshold", 1e7).alias("threshold_scaled"), F.log10(F.col("CrossSection") + 1e-10).alias("log_xs"),
    ]


def edges(df: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One edge per row whose reaction leads from a known nuclide to a known nuclide."""
    known = materialize((nodes if nodes is not None else node_index(df)).select(*NODE, "node"))
    steps = F.create_map(*[F.lit(x) for pair in MASS_STEPS.items() for x in pair])
    moved = df.filter(F.col("MT").isin(list(MASS_STEPS))).withColumn(
        "__to", F.col("A") + F.try_element_at(steps, F.col("MT")))
    source = checked_broadcast(known.withColumnRenamed("node", "source"))
    target = checked_broadcast(known.select(F.col("Z"), F.col("A").alias("__to"), F.col("node").alias("target")))
    return moved.join(source, NODE).join(target, ["Z", "__to"]).select("source", "target", "MT", *_edge_features(df))


def reaction_graph(df: DataFrame, masses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    nodes = node_features(df, masses)
    return nodes, edges(df, nodes)


def energy_grid(spark, decades: float = GRID_DECADES, points: int = GRID_POINTS) -> DataFrame:
    """Energies spaced evenly in log10 from 1 eV."""
    return spark.range(points).select(
        F.col("id").cast("int").alias("bin"), F.pow(F.lit(10.0), F.col("id") * decades / (points - 1)).alias("grid_energy"))


def close_to(energy: Column, at: Column, relative: float = 1e-3, absolute: float = 1e-8) -> Column:
    return F.abs(energy - at) <= absolute + relative * F.abs(at)


def energy_slice(df: DataFrame, energy: float, grid: Sequence[float] | None = None) -> DataFrame:
    """Self-loop edges of the rows at an energy, or at the nearest grid energy if none is."""
    nodes = materialize(node_index(df).select(*NODE, "node"))
    rows = df.filter(close_to(F.col("Energy"), F.lit(float(energy))))
    if rows.isEmpty():
        points = grid or [10 ** (i * GRID_DECADES / (GRID_POINTS - 1)) for i in range(GRID_POINTS)]
        nearest = min(points, key=lambda p: abs(p - energy))
        rows = df.filter(close_to(F.col("Energy"), F.lit(float(nearest))))
    return rows.join(checked_broadcast(nodes), NODE).select(
        F.col("node").alias("source"), F.col("node").alias("target"), "MT", *_edge_features(df))


def energy_slices(df: DataFrame, points: int = GRID_POINTS, decades: float = GRID_DECADES) -> DataFrame:
    """Rows of every grid energy at once.

    Grid lines are far further apart than the tolerance, so a row can only match the line
    nearest in log10; that line is computed, not searched.
    """
    usable = df.filter(finite("Energy") & (F.col("Energy") > 0))
    step = decades / (points - 1)
    at = F.round(F.log10("Energy") / step)
    line = F.pow(F.lit(10.0), at * step)
    return usable.withColumns({"bin": at.cast("int"), "grid_energy": line}).filter(
        F.col("bin").between(0, points - 1) & close_to(F.col("Energy"), F.col("grid_energy")))


def k_hop(edge_table: DataFrame, nodes: DataFrame, z: int, a: int, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` edges of a nuclide, either direction, with their distance."""
    start = nodes.filter((F.col("Z") == z) & (F.col("A") == a)).select("node")
    if start.isEmpty():
        raise ValueError(f"nuclide Z={z}, A={a} is not in the graph")
    pairs = edge_table.select("source", "target").distinct()
    # Distinct node pairs: bounded by the square of the nuclides, whatever the rows.
    links = materialize(pairs.union(pairs.select("target", "source")).distinct().toDF("from", "to"))
    reached = start.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        frontier = reached.filter(F.col("hop") == hop - 1)
        found = links.join(frontier, links["from"] == frontier["node"]).select(F.col("to").alias("node")).distinct()
        fresh = found.join(reached, "node", "left_anti").withColumn("hop", F.lit(hop))
        reached = materialize(reached.unionByName(fresh))
    return reached.join(nodes.select("node", *NODE), "node")
