"""Column names and types of the measurement tables."""

from __future__ import annotations

from pyspark.sql import types as T

MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("Entry", T.StringType()),
    T.StructField("Z", T.IntegerType()),
    T.StructField("A", T.IntegerType()),
    T.StructField("Projectile", T.StringType()),
    T.StructField("MT", T.IntegerType()),
    T.StructField("Energy", T.DoubleType()),
    T.StructField("Energy_Uncertainty", T.DoubleType()),
    T.StructField("CrossSection", T.DoubleType()),
    T.StructField("Uncertainty", T.DoubleType()),
    T.StructField("N", T.IntegerType()),
])

# Nested payload of one dataset: energies and values with their errors.
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("c5data", T.StructType([
        T.StructField("x1", T.StructType([
            T.StructField("x1", T.ArrayType(T.DoubleType())),
            T.StructField("dx1", T.ArrayType(T.DoubleType())),
        ])),
        T.StructField("y", T.StructType([
            T.StructField("y", T.ArrayType(T.DoubleType())),
            T.StructField("dy", T.ArrayType(T.DoubleType())),
        ])),
    ])),
])

# Accepted source spellings (lower case) of each canonical column.
COLUMN_ALIASES = {
    "Entry": ["entry_id", "entry", "entryid", "datasetid"],
    "Z": ["target_z", "z", "atomic_number"],
    "A": ["target_a", "a", "mass_number"],
    "MT": ["reaction_mt", "mt", "mt_code"],
    "Projectile": ["proj", "projectile", "particle"],
    "Energy": ["energy", "energy_value", "en"],
    "Energy_Uncertainty": ["den", "d_energy", "energy_error", "energy_uncertainty"],
    "CrossSection": ["xs", "data", "cross_section", "sigma", "value", "crosssection"],
    "Uncertainty": ["dxs", "ddata", "uncertainty", "error", "d_cross_section"],
    "Year": ["year"],
    "Author": ["author"],
    "ReactionType": ["reactiontype"],
    "NDataPoints": ["ndatapoints"],
    "FullCode": ["fullcode"],
}
REQUIRED_COLUMNS = ["Z", "A", "MT", "Energy", "CrossSection"]
METADATA_COLUMNS = ["sf5", "sf6", "sf8", "sf9", "is_pure", "data_type"]
DIAGNOSTIC_COLUMNS = ["Year", "Author", "ReactionType", "NDataPoints", "FullCode"]

# Columns a filtered load needs: keys, values, and everything a later filter reads.
ESSENTIAL_COLUMNS = [
    "Entry", "Z", "A", "N", "Projectile", "MT", "Energy", "Energy_Uncertainty",
    "CrossSection", "Uncertainty", "sf8", "z_score", "gp_mean", "gp_std",
    "experiment_id", "experiment_outlier",
]

GROUP_KEYS = ["Z", "A", "MT", "Projectile"]
