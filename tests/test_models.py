"""Training, prediction, saved experiments and searches on one small frame."""

import numpy as np
import pandas as pd
import pytest

from crossfield.operators import models
from crossfield.operators.select import Holdout, Selection


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 600
    energy = 10 ** rng.uniform(0, 6, n)
    z = rng.integers(1, 4, n)
    xs = 10 ** (z - 0.5 * np.log10(energy)) * rng.lognormal(0, 0.05, n)
    return spark.createDataFrame(pd.DataFrame({
        "Z": z, "A": z * 2, "MT": 18, "Energy": energy, "CrossSection": xs, "Uncertainty": xs * 0.1, "Entry": "E"})).cache()


def test_train_predict_save_load(spark, frame, tmp_path):
    model = models.train(frame, models.decision_tree(weighted=True, maxDepth=8), weight_mode="xs")
    assert model.metrics["train_r2_log"] > 0.9 and model.metrics["test_r2_log"] > 0.8 and model.metrics["depth"] <= 8
    path = str(tmp_path / "m")
    models.save_experiment(model, spark, path, Selection(), Holdout([{"Z": 2}]), note="x")
    again, properties = models.load_experiment(spark, path)
    assert properties["extra"] == {"note": "x"} and properties["holdout"] == {"rules": [{"Z": 2}]}
    a = model.predict(frame).orderBy("Energy").toPandas()
    b = again.predict(frame).orderBy("Energy").toPandas()
    assert np.allclose(a.prediction, b.prediction) and np.allclose(a.CrossSection, frame.toPandas().sort_values("Energy").CrossSection)
    assert model.importance(spark).first().feature == "Energy"
    with pytest.raises(RuntimeError):
        models.save_experiment(models.Model(), spark, path)
    with pytest.raises(ValueError):
        model.predict(frame.drop("Z"))
    with pytest.raises(ValueError):
        models.decision_tree(maxDepth=31)


def test_searches(frame):
    tree = models.decision_tree()
    maps = models.random_maps(tree, {"maxDepth": [1, 3, 6]}, 2)
    assert len(maps) == 2
    _, found = models.search(frame, tree, maps, folds=2, validation="holdout")
    assert found["best"]["maxDepth"] == max(list(m.values())[0] for m in maps) and found["test_mse"] > 0
    _, kept = models.successive_halving(frame, tree, models.grid_maps(tree, {"maxDepth": [1, 5]}), min_rows=200, folds=2)
    assert kept["best"] == {"maxDepth": 5}


def test_a_trainer_scans_stored_rows(frame, monkeypatch):
    """Features are computed once, not for each scan of the trainer; a partition has a bounded number of rows."""
    from crossfield.operators.transform import Scaler

    monkeypatch.setattr(models, "PART_ROWS", 100)
    rows, features = models._kept_rows(frame.withColumn("Half", frame.Z / 2), Scaler(), weight_mode="xs")
    assert "Half" in features and set(rows.columns) == {*features, "target", "weight"}
    assert rows.rdd.getNumPartitions() >= 6 and rows.count() == 600
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Project" not in plan and "parquet" in plan


def test_a_search_fits_on_cells_as_on_rows(frame):
    """Rows with equal bins are one weighted row of a fit; trees and scores are those of all rows."""
    from pyspark.sql import functions as F

    few = frame.select("CrossSection", F.round(F.log10("Energy")).alias("e"), "Z")
    rows, features = models._kept_rows(models.drawn_folds(few, 3, 1), models.Scaler())
    tree = models.decision_tree()
    maps = models.grid_maps(tree, {"maxDepth": [0, 2, 5], "minInstancesPerNode": [1, 40, 500]})
    cells = models._fits(rows, features, tree, maps, ["fold"], 4)
    plain = models._Fits(rows, [models.VectorAssembler(inputCols=features, outputCol="features")], False, 4)
    assert cells.table.count() <= 3 * 7 * 3 and cells.table.agg(F.sum("rows")).first()[0] == 600
    got, want = (models._cross_validated(f, tree, maps, 3) for f in (cells, plain))
    assert np.allclose(got, want, rtol=1e-9) and len({round(s, 9) for s in got}) == 4
    model, found = models.search(few, tree, maps[:2], folds=2)
    assert model.predict(few).count() == 600 and model.metrics["test_r2_log"] is not None and found["score"] == min(s for _, s in found["scores"])


def test_bins_of_many_values_are_about_equal(spark):
    from pyspark.sql import functions as F

    rows = spark.range(10_000).select(F.exp(F.col("id") / 1000).alias("many"), (F.col("id") % 3 - 1).cast("double").alias("few"), F.lit(2.0).alias("one"))
    counts = models._bins(rows, rows.columns, 32).transform(rows)
    many = counts.groupBy("__bin_many").count()
    assert many.count() == 32 and many.filter("count NOT BETWEEN 305 AND 320").isEmpty()
    assert counts.select("few", "__bin_few").distinct().count() == 3 and counts.select("__bin_one").distinct().count() == 1


def test_the_boosted_query_grows_all_trees(spark, monkeypatch):
    """The query trains with the operator's own settings, not with fewer or smaller trees."""
    from crossfield.catalog import modelling

    seen = []

    def train(rows, estimator, **options):
        seen.append(estimator)
        return models.Model(metrics={"n": rows.count()})

    monkeypatch.setattr(modelling.models, "train", train)
    found = modelling.boosted(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 1 and found[0].value > 5000
    assert {k: seen[0].getOrDefault(k) for k in models.BOOSTED_DEFAULTS} == models.BOOSTED_DEFAULTS
    assert models.BOOSTED_DEFAULTS["maxIter"] == 100 and models.BOOSTED_DEFAULTS["maxDepth"] == 6
