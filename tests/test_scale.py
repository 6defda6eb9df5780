"""The split plans of hot keys give what the simple plans give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield.operators.profile import training_units
from crossfield.plans.ordering import with_previous, with_tiles
from crossfield.plans.quantiles import column_percentiles, group_percentiles
from crossfield.plans import scale
from crossfield.plans.scale import attach, bytes_of, fits, grid_join, group_sizes, materialize

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key (NULL) with most rows, ties included."""
    keys = [None] * 600 + ["b"] * 90 + ["c"] * 10
    values = np.round(RNG.lognormal(0, 2, len(keys)), 2)
    values[:150] = 3.25
    return spark.createDataFrame(pd.DataFrame({"k": keys, "v": values, "i": range(len(keys))})).cache()


def test_percentiles_by_narrowing(spark, skewed):
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    simple = {r.k: r for r in group_percentiles(skewed, ["k"], "v", shares).collect()}
    split = {r.k: r for r in group_percentiles(skewed, ["k"], "v", shares, limit=40).collect()}
    frame = skewed.toPandas()
    assert set(simple) == set(split) == {None, "b", "c"}
    for key, row in split.items():
        rows = frame[frame.k.isna()] if key is None else frame[frame.k == key]
        for name, share in shares.items():
            want = np.percentile(rows.v, share * 100)
            assert row[name] == pytest.approx(want) and simple[key][name] == pytest.approx(want)


@pytest.mark.parametrize("options", [{}, {"limit": 40}, {"limit": 40, "counts": {"v": 700, "twice": 690, "none": 0}}])
def test_percentiles_of_several_columns(skewed, options):
    columns = {"v": "v", "twice": F.when(F.col("i") >= 10, F.col("v") * 2), "none": F.lit(None).cast("double")}
    row = column_percentiles(skewed, columns, {"q": 0.25, "m": 0.5}, **options).first()
    values = skewed.toPandas()
    for name, share in (("q", 25), ("m", 50)):
        assert row[f"v__{name}"] == pytest.approx(np.percentile(values.v, share))
        assert row[f"twice__{name}"] == pytest.approx(np.percentile(values.v[values.i >= 10] * 2, share))
        assert row[f"none__{name}"] is None


def test_percentiles_of_several_columns_take_two_scans(spark, skewed):
    """One job counts, and the result itself is one more scan, however many columns there are."""
    accumulator = spark.sparkContext.accumulator(0)
    def seen(batches):
        for batch in batches:
            accumulator.add(batch.num_rows)
            yield batch
    counted = skewed.mapInArrow(seen, skewed.schema)
    column_percentiles(counted, {f"c{i}": F.col("v") * i for i in range(1, 6)}, {"m": 0.5}).collect()
    assert accumulator.value == 2 * 700


def test_percentiles_ignore_null_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, None)], "k int, v double")
    rows = group_percentiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert [(r.k, r.m) for r in rows] == [(1, 2.0)]


def test_hot_keys_are_found(skewed):
    sizes = group_sizes(skewed, ["k"], limit=100)
    assert not sizes.bounded and sizes.largest == 600 and [r.k for r in sizes.hot().collect()] == [None]
    ordinary, hot = sizes.split(skewed)
    assert (ordinary.count(), hot.count()) == (100, 600)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 1}, {"broadcast_rows": 1, "hot_rows": 100}])
def test_attach_keeps_rows_and_null_keys(spark, skewed, options):
    facts = spark.createDataFrame([(None, 1), ("b", 2)], "k string, fact int")
    rows = attach(skewed, facts, ["k"], **options)
    counts = {(r.k, r.fact): r["count"] for r in rows.groupBy("k", "fact").count().collect()}
    assert counts == {(None, 1): 600, ("b", 2): 90, ("c", None): 10}


@pytest.mark.parametrize("limit", [10**6, 50])
def test_previous_rows_across_tiles(skewed, limit):
    window = Window.partitionBy("k").orderBy("v", "i")
    want = skewed.select("i", F.lag("i", 1).over(window).alias("a"), F.lag("i", 2).over(window).alias("b"))
    got = with_previous(skewed, ["k"], ["v", "i"], [], limit).select(
        "i", F.col("prev1.i").alias("a"), F.col("prev2.i").alias("b"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_tiles_follow_the_order(skewed):
    tiles = with_tiles(skewed.filter("k IS NULL"), ["k"], "v", 100).groupBy("__tile").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("__tile").collect()
    assert len(tiles) > 2 and all(a.hi <= b.lo for a, b in zip(tiles, tiles[1:]))


def test_training_units_come_in_parts(spark):
    df = spark.createDataFrame([(1, 1, 2, float(e), float(e)) for e in range(500)], "Z int, A int, MT int, Energy double, CrossSection double")
    parts = training_units(df, limit=100).orderBy("part").collect()
    assert len(parts) > 3 and [e for p in parts for e in p.energies] == [float(e) for e in range(500)]


def test_percentiles_end_on_infinities_nan_and_wide_ranges(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "inf": list(range(300)) + [inf], "minus": [-inf] * 3 + list(range(200)), "nan": list(range(200)) + [nan] * 5,
        "both": [-inf] * 50 + [1.0, 2.0] + [inf] * 51, "wide": [10.0**e for e in range(-307, 308)] + [-(10.0**e) for e in range(-307, 308)],
        "ties": [7.0] * 400 + [8.0], "only": [inf] * 90,
    }
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values], "k string, v double")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    simple = {r.k: r for r in group_percentiles(df, ["k"], "v", shares).collect()}
    split = {r.k: r for r in group_percentiles(df, ["k"], "v", shares, limit=40).collect()}
    assert set(simple) == set(split) == set(groups)
    for k in groups:
        for name in shares:
            assert split[k][name] == pytest.approx(simple[k][name], nan_ok=True), (k, name)


@pytest.mark.parametrize("kind", ["log", "ties"])
def test_tiles_keep_their_limit(spark, kind):
    values = 10 ** RNG.uniform(-5, 9, 4000) if kind == "log" else np.where(RNG.uniform(size=4000) < 0.6, 2.5, RNG.uniform(0, 5, 4000))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": values}))
    tiles = with_tiles(df, ["k"], "v", 100).groupBy("__tile").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("__tile").collect()
    assert sum(t.n for t in tiles) == 4000 and max(t.n for t in tiles) <= 100 and all(a.hi <= b.lo for a, b in zip(tiles, tiles[1:]))


def task_rows(df):
    """Rows of each task of the result's last stage."""
    counts = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    return sorted(r["count"] for r in counts)


@pytest.fixture
def no_merging(spark):
    """Many shuffle partitions that adaptive execution leaves alone."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def one_third_hot(spark, n=12_000):
    """A third of the rows under one key, the others spread."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2000).alias("k"), F.col("id").alias("i"))


def test_attach_beyond_the_bound_is_even(spark, no_merging):
    rows = one_third_hot(spark)
    facts = rows.select("k").distinct().filter("k % 5 <> 2").withColumn("fact", F.col("k") * 2)
    want = sorted(map(tuple, rows.join(facts, "k", "left").select("i", "fact").collect()))
    out = attach(rows, facts, ["k"], broadcast_rows=1, hot_rows=50)
    assert sorted(map(tuple, out.select("i", "fact").collect())) == want
    sizes = task_rows(out)
    assert len(sizes) == 40 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("cell", [10, 10**6])
def test_grid_join_equals_the_plain_join(spark, how, cell):
    left = one_third_hot(spark, 900).withColumn("k", F.when(F.col("i") % 50 != 7, F.col("k")))
    right = spark.range(160).select((F.col("id") % 40 - 20).alias("k"), F.col("id").alias("j"), F.when(F.col("id") % 7 == 0, "x").alias("s"))
    hot = spark.range(75).select(F.lit(-1).cast("long").alias("k"), (F.col("id") + 1000).alias("j"), F.lit("y").alias("s"))
    right = right.union(hot).union(hot)                     # equal rows too
    out = grid_join(left, right, ["k"], how, cell)
    assert out.columns == ["k", "i", "j", "s"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)


def test_grid_join_spreads_a_hot_key(spark, no_merging):
    left = one_third_hot(spark)
    right = spark.range(1200).select(F.when(F.col("id") < 100, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("j"))
    plain, grid = left.join(right, "k"), grid_join(left, right, ["k"], cell=20)
    assert grid.count() == plain.count()
    assert task_rows(plain)[-1] > 0.9 * plain.count()
    sizes = task_rows(grid)
    assert len(sizes) == 40 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_one_table_on_both_sides(spark):
    rows = one_third_hot(spark, 300)
    out = grid_join(rows, rows.withColumnRenamed("i", "j"), ["k"], cell=10)
    assert out.count() == rows.join(rows.withColumnRenamed("i", "j"), "k").count()


def test_bytes_bound_a_broadcast(spark, monkeypatch):
    small = materialize(spark.range(10).withColumn("text", F.repeat(F.lit("x"), 1000)))
    assert 10_000 < bytes_of(small) < 20_000 and fits(small)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 5_000)
    assert not fits(small)


def test_hot_keys_always_fit_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 5)
    counts = spark.range(100).withColumn("n", F.lit(10))
    assert scale.hot_blocks(counts, F.col("n"), 1).count() == 0      # the limit rose to 1000 / 5
