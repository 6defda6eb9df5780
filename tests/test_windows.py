"""Sliding medians of long windows against sorting every window."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crossfield.plans import windows
from crossfield.plans.windows import RankedStretch, window_medians


def brute(v, s, e):
    med = np.array([np.median(v[a:b]) for a, b in zip(s, e)])
    return med, np.array([np.median(np.abs(v[a:b] - m)) for a, b, m in zip(s, e, med)])


def data(kind, n=3000, seed=0):
    r = np.random.default_rng(seed)
    x = np.sort(r.uniform(0, 10, n) if kind != "uneven" else np.concatenate([r.uniform(0, 10, n // 10), r.normal(3, 0.05, n - n // 10)]))
    v = {"normal": r.normal(size=n), "uneven": r.normal(size=n), "ties": np.round(r.normal(size=n), 1), "same": np.full(n, 2.5),
         "clumps": np.where(r.uniform(size=n) < 0.5, -1.0, 1.0) + r.normal(0, 0.01, n), "skew": r.lognormal(0, 2, n),
         "trend": x * 3 + r.normal(size=n), "steps": np.floor(x) + r.choice([0.0, 100.0], n)}[kind]
    return x, v, np.searchsorted(x, x - 1.0), np.searchsorted(x, x + 1.0, "right")


KINDS = ["normal", "uneven", "ties", "same", "clumps", "skew", "trend", "steps"]


def test_equals_sorting_every_window(spark):
    """Each kind of data is a group of 3,000 rows under a limit of 150; one group has a null key."""
    groups = {kind: data(kind)[1:] for kind in KINDS}
    groups[None] = (groups["normal"][0][:50], np.zeros(50, int), np.full(50, 50))
    frame = pd.concat([pd.DataFrame({"k": pd.Series([k] * len(v), dtype=object), "rank": range(len(v)), "v": v, "s": s, "e": e})
                       for k, (v, s, e) in groups.items()])
    df = spark.createDataFrame(frame, "k string, rank long, v double, s long, e long")
    got = window_medians(df, ["k"], 150, spread=True).toPandas().sort_values("rank")
    for key, (v, s, e) in groups.items():
        own = got[got.k.isna()] if key is None else got[got.k == key]
        med, mad = brute(v, s, e)
        assert own["rank"].tolist() == list(range(len(v))), key
        assert np.allclose(own["median"], med, rtol=0, atol=1e-12), key
        assert np.allclose(own["mad"], mad, rtol=1e-12, atol=1e-12), key


def test_rows_without_a_window_only_fill_the_others(spark):
    v = np.random.default_rng(1).normal(size=900)
    s = [i - 100 if 200 <= i < 700 else None for i in range(900)]
    frame = pd.DataFrame({"k": "a", "rank": range(900), "v": v, "s": s, "e": [None if a is None else a + 201 for a in s]})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k string, rank long, v double, s double, e double")
    df = df.withColumns({"s": F.col("s").cast("long"), "e": F.col("e").cast("long")})
    got = window_medians(df, ["k"], 80).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(200, 700))
    assert np.allclose([r["median"] for r in got], [np.median(v[i - 100:i + 101]) for i in range(200, 700)])


def test_a_tile_reads_a_bounded_number_of_rows(spark, monkeypatch):
    """Whatever the window's length: own rows, edges and a few buckets."""
    x, v, s, e = data("normal", 6000)
    frame = pd.DataFrame({"k": 1, "rank": range(len(v)), "v": v, "s": s, "e": e})
    df, limit = spark.createDataFrame(frame), 200
    sent = []
    original = windows._read_core
    monkeypatch.setattr(windows, "_read_core", lambda *a: sent.append(original(*a)) or sent[-1])
    edges = []
    deal = windows._edge_rows
    monkeypatch.setattr(windows, "_edge_rows", lambda *a: edges.append(deal(*a)) or edges[-1])
    window_medians(df, ["k"], limit, spread=True).count()
    per_tile = edges[0].groupBy("tile").count().agg(F.max("count")).first()[0]
    assert per_tile <= 1.6 * limit
    for core in sent:
        cells = [c for c in core.columns if c in ("tile", "run")]
        assert core.groupBy(*cells).count().agg(F.max("count")).first()[0] <= 8 * limit
    per_row = edges[0].groupBy("rank").count().agg(F.avg("count")).first()[0]
    assert per_row <= 4


def test_ranked_stretch():
    r = np.random.default_rng(2)
    sequence, fixed = r.integers(0, 40, 200), r.integers(0, 40, 60)
    ranked = RankedStretch(sequence, fixed, 40)
    first = r.integers(0, 100, 300)
    last = first + r.integers(0, 100, 300)
    k = r.integers(0, 60, 300)
    want = [sorted([*sequence[a:b], *fixed])[i] for a, b, i in zip(first, last, k)]
    assert ranked.select(first, last, k).tolist() == want
    assert ranked.below(first, last, 17).tolist() == [(sequence[a:b] < 17).sum() for a, b in zip(first, last)]


def test_short_windows_are_read_whole(spark, monkeypatch):
    """Windows within a tile: no bucket counts, no core rows, a bounded reach, the same numbers."""
    monkeypatch.setattr(windows, "_tiles", None)
    monkeypatch.setattr(windows, "_read_core", None)
    groups = {kind: data(kind, 700)[1] for kind in KINDS} | {None: np.arange(50.0)}
    frame = pd.concat([pd.DataFrame({"k": pd.Series([k] * len(v), dtype=object), "rank": range(len(v)), "v": v,
                                     "s": np.maximum(np.arange(len(v)) - 30, 0), "e": np.minimum(np.arange(len(v)) + 31, len(v))}) for k, v in groups.items()])
    df = spark.createDataFrame(frame, "k string, rank long, v double, s long, e long")
    got = window_medians(df, ["k"], 61, spread=True).toPandas().sort_values("rank")
    for key, v in groups.items():
        own, at = got[got.k.isna()] if key is None else got[got.k == key], np.arange(len(v))
        med, mad = brute(v, np.maximum(at - 30, 0), np.minimum(at + 31, len(v)))
        assert own["rank"].tolist() == at.tolist() and np.allclose(own["median"], med) and np.allclose(own["mad"], mad), key
