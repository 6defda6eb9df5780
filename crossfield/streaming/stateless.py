"""The row-wise operators on a streaming DataFrame.

Classification, quality rules, particle features and a static reference join keep no
state, so the batch code runs on a stream unchanged. Nothing else of the library streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield.operators.classify import classify, clean_sf
from crossfield.operators.features import add_geometry, add_particles
from crossfield.operators.quality import quality_filter


def clean_stream(points: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Quality filter, purity label and features of arriving points.

    ``reference`` is a static table with one row per (Z, A); Spark re-plans that join per
    micro-batch and broadcasts it only under its own size threshold.
    """
    rows = add_geometry(add_particles(classify(clean_sf(quality_filter(points)))))
    if reference is None:
        return rows
    return rows.join(reference, ["Z", "A"], "left")


def only_pure(points: DataFrame) -> DataFrame:
    return points.filter(F.col("is_pure"))
