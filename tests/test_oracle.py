"""A spread of catalogued queries against their SQL; tests/oracle_check.py runs them all."""

import pytest
from conftest import TABLES
from oracle_check import compare, connect

import __spark_entry__ as entry

SPREAD = [
    "s01_nested_payload_scan", "s04_split_table_scan", "s10_fixed_width_masses", "s13_fixed_width_structure",
    "f03_quality_stage_counts", "f06_reaction_fields", "f10_priority_label", "f14_reaction_modes", "f22_holdout_split",
    "c01_particle_vector", "c04_shell_features", "c09_spin_parity", "c19_log_error_bars", "j04_reference_build",
    "j06_enrichment", "t06_tier_features", "t01_scaler_robust", "t10_sample_weights_both", "a12_group_statistics",
    "a26_gini", "a31_energy_density", "m12_resonance_penalties", "g02_edges", "r04_best_candidate", "w01_outlier_scores",
    "f31_state_of_full_scores", "m03_two_levels_by_sql", "m08_importance_by_sql",
]


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, TABLES), con, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["Z", "A", "count", "N"] and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_row_scores_can_be_stored_and_equal_their_sql_as_a_table(spark, con, tmp_path):
    """Spark takes no file with names that differ only by case, as the Z and z of this SQL; DuckDB stores them as Z and z_1."""
    path, name = str(tmp_path / "scores"), "w01_row_scores"
    entry.queries()[name](spark, TABLES).write.parquet(path)
    con.execute(f"CREATE VIEW row_scores AS {entry.oracle_sql()[name]}")
    stored = spark.read.parquet(path)
    assert stored.select("Z").count() > 0 and compare(stored, con, "SELECT * FROM row_scores") is None
