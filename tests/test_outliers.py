"""Scoring against brute force, injected outliers, and the plan for hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossfield.operators import group_fit as G
from crossfield.operators import outliers

KEYS = ["Z", "A", "MT", "Projectile"]


def experiments(n=300, offset=0.0, bad_points=0, seed=1):
    """A smooth trend measured by four experiments, one of them shifted by ``offset``."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 8, n)
    y = 2 - 0.3 * x + rng.normal(0, 0.1, n)
    entry = rng.integers(0, 4, n)
    y[entry == 3] += offset
    y[:bad_points] += 3
    return pd.DataFrame({
        "Z": 1, "A": 2, "MT": 18, "Projectile": "n", "Energy": 10**x, "CrossSection": 10**y,
        "Uncertainty": 0.03 * 10**y, "Entry": [f"E{e}" for e in entry], "row": range(n)})


def brute_rolling_mad(x, r, fraction=0.1, least=15):
    half, out = max((x[-1] - x[0]) * fraction, 0.1), []
    for i in range(len(x)):
        near = r[(x >= x[i] - half) & (x <= x[i] + half)]
        if len(near) < least:
            near = r[sorted(range(len(x)), key=lambda j: (abs(x[j] - x[i]), x[j], r[j]))[:least]]
        out.append(np.median(np.abs(near - np.median(near))) * 1.4826)
    return np.array(out)


@pytest.mark.parametrize("n", [10, 14, 60, 257])
def test_rolling_mad_is_exact(n):
    rng = np.random.default_rng(n)
    x = np.sort(np.round(rng.uniform(0, 3, n) ** 2, 2))
    r = rng.normal(size=n)
    order = np.lexsort((r, x))
    assert np.allclose(G.rolling_mad(x[order], r[order]), brute_rolling_mad(x[order], r[order]))


def test_median_filter_repeats_the_ends():
    values = np.random.default_rng(0).normal(size=40)
    padded = np.concatenate([[values[0]] * 3, values, [values[-1]] * 3])
    want = [np.median(padded[i:i + 7]) for i in range(40)]
    assert np.allclose(G.median_filter(values, 7), want)


def test_cubic_resists_outliers():
    x = np.linspace(0, 10, 200)
    y = 0.01 * x**3 - x + np.random.default_rng(2).normal(0, 0.02, 200)
    y[::20] += 5
    assert np.max(np.abs(G.robust_cubic(x, y)(x) - (0.01 * x**3 - x))) < 0.1


def test_constant_trend_for_few_energies():
    trend = G.robust_cubic(np.array([1.0, 1.0, 2.0]), np.array([1.0, 3.0, 5.0]))
    assert np.allclose(trend(np.array([0.0, 9.0])), 3.5)


def scores(spark, frame, **options):
    return outliers.score(spark.createDataFrame(frame), outliers.OutlierConfig(**options)).toPandas().sort_values("row")


def test_injected_points_and_clean_experiments(spark):
    out = scores(spark, experiments(bad_points=6))
    assert out.point_outlier[:6].all() and out.point_outlier[6:].mean() < 0.06
    assert not out.experiment_outlier.any() and (out.z_score >= 0).all()


def test_shifted_experiment_is_flagged(spark):
    out = scores(spark, experiments(offset=1.5))
    assert set(out.Entry[out.experiment_outlier]) == {"E3"} and out.experiment_outlier.sum() == (out.Entry == "E3").sum()


def test_small_groups_take_the_median(spark):
    out = scores(spark, experiments(n=8))
    assert out.gp_mean.nunique() == 1 and out.gp_mean.iloc[0] == pytest.approx(np.median(out.log_sigma))
    assert not out.experiment_outlier.any()


def test_null_projectile_is_a_group_or_skipped(spark):
    frame = pd.concat([experiments(n=30), experiments(n=30, seed=5).assign(Projectile=None, row=range(30, 60))])
    schema = "Z int, A int, MT int, Projectile string, Energy double, CrossSection double, Uncertainty double, Entry string, row int"
    df = spark.createDataFrame(frame.astype({"Projectile": object}).where(frame.notna(), None), schema)
    assert outliers.score(df).filter("z_score IS NULL").count() == 0
    skipped = outliers.score(df, outliers.OutlierConfig(skip_null_projectile=True))
    assert skipped.filter("z_score IS NULL AND NOT point_outlier AND NOT experiment_outlier").count() == 30


def test_required_columns(spark):
    with pytest.raises(ValueError):
        outliers.score(spark.createDataFrame([(1,)], "Z int"))


def test_a_group_over_the_limit_gets_the_same_scores(spark, n=3000, limit=150):
    """Tiles of a hot group against one task: every row's trend, sigma, score and flags."""
    frame = experiments(n=n, offset=0.8, bad_points=5)
    frame["Energy"] = 10 ** np.round(np.log10(frame.Energy), 1)
    frame.loc[frame.index[-40:], "Energy"] = 10.0 ** np.linspace(9, 14, 40)  # sparse windows
    whole, tiled = scores(spark, frame), scores(spark, frame, score_rows=limit)
    for name in ("gp_mean", "gp_std", "z_score"):
        assert np.allclose(whole[name], tiled[name], rtol=1e-6, atol=1e-9), name
    assert (whole.point_outlier == tiled.point_outlier).all() and (whole.experiment_outlier == tiled.experiment_outlier).all()


def test_rows_without_an_id_are_one_experiment(spark):
    frame = experiments(offset=1.5)
    frame["Entry"] = frame.Entry.where(frame.Entry != "E3", None)
    out = scores(spark, frame)
    assert out.experiment_outlier.sum() == frame.Entry.isna().sum() and set(out.experiment_id[out.experiment_outlier]) == {"unknown"}
    by_plan = outliers.flag_experiments(spark.createDataFrame(out[[*KEYS, "Entry", "z_score", "row"]]), KEYS, entry="Entry").toPandas()
    assert set(by_plan.row[by_plan.experiment_outlier]) == set(out.row[out.experiment_outlier])


def test_null_keys_keep_density_and_surface(spark):
    frame = experiments(n=30).assign(Projectile=None)
    schema = "Z int, A int, MT int, Projectile string, Energy double, CrossSection double, Uncertainty double, Entry string, row int"
    df = spark.createDataFrame(frame.astype({"Projectile": object}).where(frame.notna(), None), schema)
    from crossfield.operators.profile import energy_density, with_logs

    assert energy_density(with_logs(df), KEYS).agg(F.sum("n")).first()[0] == 30
    cells = outliers.probability_surface(outliers.score(df), KEYS, grid=5)
    assert cells.count() == 25 and cells.filter("density IS NULL").count() == 0


@pytest.mark.parametrize("limit", [10**6, 50])
def test_scores_and_flags_in_one_shuffle_equal_the_joined_ones(spark, limit):
    frames = [experiments(n, offset=25.0, bad_points=n // 20, seed=n).assign(A=n) for n in (1, 8, 40, 90, 200)]
    one = experiments(60, seed=3).assign(A=61, Entry="E0")
    holes = experiments(60, offset=25.0, seed=4).assign(A=62)
    holes["Entry"] = holes.Entry.map({"E3": None}.get).astype(object).where(holes.Entry == "E3", "E0")
    flat = experiments(30, seed=5).assign(A=63, CrossSection=2.0)
    df = spark.createDataFrame(pd.concat([*frames, one, holes, flat], ignore_index=True))
    rows = outliers.prepare(df, outliers.OutlierConfig())
    keys, names = ["Z", "A", "MT"], ["A", "row", "gp_mean", "gp_std", "z_score", "point_outlier", "experiment_outlier"]
    got = outliers.score_experiments(rows, keys, "Entry", limit=limit).select(*names).toPandas().sort_values(["A", "row"])
    joined = outliers.flag_experiments(outliers._hot_median_scores(rows, keys, "log_sigma", 3.0, limit), keys, "Entry")
    want = joined.select(*names).toPandas().sort_values(["A", "row"])
    assert got.experiment_outlier.any() and not got.experiment_outlier.all()
    assert np.allclose(got[names[:5]], want[names[:5]]) and (got[names[5:]].values == want[names[5:]].values).all()
    assert got[(got.A == 62)].experiment_outlier.any() and not got[got.A == 61].experiment_outlier.any()


def test_a_large_table_is_scored_without_windows_over_its_rows(spark):
    df = spark.createDataFrame(pd.concat([experiments(n, offset=25.0, bad_points=n // 20, seed=n).assign(A=n) for n in (1, 8, 40, 200)]))
    rows, keys = outliers.prepare(df, outliers.OutlierConfig()), ["Z", "A", "MT"]
    names = ["A", "row", "gp_mean", "gp_std", "z_score", "point_outlier", "experiment_outlier"]
    large, small = outliers.score_experiments(rows, keys, "Entry", shuffled_rows=100), outliers.score_experiments(rows, keys, "Entry")
    assert "Window" not in large._jdf.queryExecution().optimizedPlan().toString()
    got, want = (d.select(*names).toPandas().sort_values(["A", "row"]) for d in (large, small))
    assert np.allclose(got[names[:5]], want[names[:5]]) and (got[names[5:]].values == want[names[5:]].values).all() and got.experiment_outlier.any()


@pytest.mark.parametrize("limit", [10**6, 20])
def test_small_policy_counts_groups_without_a_join(spark, limit):
    df = spark.createDataFrame(pd.concat([experiments(n, seed=n).assign(A=n) for n in (1, 2, 40)]))
    rows = outliers.prepare(df, outliers.OutlierConfig())
    out = outliers.score_small_policy(rows, ["Z", "A", "MT"], size_as="size", limit=limit)
    assert limit == 20 or "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = out.toPandas()
    assert (found["size"] == found.A).all() and len(found) == 43
    lone = found[found.A == 1].iloc[0]
    assert lone.z_score == 0 and lone.gp_std == 1 and lone.gp_mean == lone.log_sigma


@pytest.mark.parametrize("kind", ["spread", "ties", "clumps", "sparse", "one value"])
@pytest.mark.parametrize("block", [60, 900, 8192])
def test_a_large_group_in_blocks_equals_the_sliding_list(monkeypatch, kind, block):
    """Deviations and running medians of a group above ``LIST_ROWS``: the same numbers, bit for bit."""
    from crossfield.plans import windows

    rng, n = np.random.default_rng(7), 2500
    x, r = rng.uniform(0, 3, n), rng.normal(size=n)
    if kind == "ties":
        x, r = np.round(x * x, 1), np.round(r, 1)
    elif kind == "clumps":
        r = r * 0.01 + np.where(rng.random(n) < 0.5, 0.0, 100.0)
    elif kind == "sparse":
        x[:60] = np.linspace(5, 60, 60)
    elif kind == "one value":
        r[:] = 0.25
    order = np.lexsort((r, x))
    x, r = x[order], r[order]
    monkeypatch.setattr(windows.block_mads, "__defaults__", (block,))
    got = G.rolling_mad(x, r), G.rolling_mad(x, r, rows=(100, 2400)), G.median_filter(r, 125)
    monkeypatch.setattr(G, "LIST_ROWS", n)
    want = G.rolling_mad(x, r), G.rolling_mad(x, r, rows=(100, 2400)), G.median_filter(r, 125)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_windows_of_equal_x_are_solved_once(monkeypatch):
    solved, blocks = [], G.block_mads
    monkeypatch.setattr(G, "block_mads", lambda v, s, e: solved.append(len(s)) or blocks(v, s, e))
    x = np.repeat(np.linspace(0, 3, 100), 300)
    G.rolling_mad(x, np.random.default_rng(1).normal(size=len(x)))
    assert solved == [100]


def test_a_group_of_some_hundred_thousand_rows_is_scored_in_a_task(spark):
    """Such a group takes one shuffle; before, its trend and windows took dozens of jobs over sorted copies."""
    rows = spark.range(300_000).selectExpr(
        "1 AS Z", "2 AS A", "18 AS MT", "'n' AS Projectile", "concat('E', id % 7) AS Entry", "1.0 + id % 50000 AS Energy",
        "2.0 + sin(id) AS CrossSection", "0.1 AS Uncertainty")
    scored = outliers.score(rows)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    assert scored.filter("gp_std IS NULL OR z_score IS NULL").count() == 0
