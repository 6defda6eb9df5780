"""Selections, holdouts, sources, features, transforms and weights on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfield.functions import labels as L
from crossfield.functions import scalars as S
from crossfield.operators import classify, evaluate, features, quality, reference, select, weights
from crossfield.operators.transform import Scaler, TransformConfig
from crossfield.sources import fixed_width, points, tables

POINT = "Entry string, Z int, A int, MT int, Projectile string, Energy double, CrossSection double, Uncertainty double, sf8 string"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    rows = [(f"E{i % 5}", int(rng.choice([1, 17, 92])), int(rng.choice([1, 35, 235])), int(rng.choice([16, 18, 102])), "n" if i % 4 else None,
             float(10 ** rng.uniform(-2, 7)), float(10 ** rng.uniform(-3, 3)), float(rng.uniform(0.01, 1)) if i % 6 else None,
             [None, "REL", "BRA/REL", "RAW"][i % 4]) for i in range(200)]
    return spark.createDataFrame(rows, POINT).cache()


def test_holdout_partitions_the_input(frame):
    rules = select.Holdout([{"Z": 92, "MT": [18, 102]}, {"energy_range": (1.0, 100.0)}, {"Entry": "E3"}])
    train, held = rules.split(frame)
    p = frame.toPandas()
    mask = ((p.Z == 92) & p.MT.isin([18, 102])) | p.Energy.between(1, 100) | (p.Entry == "E3")
    assert held.count() == mask.sum() and train.count() == (~mask).sum()
    assert select.Holdout().split(frame)[1].count() == 0


@pytest.mark.parametrize("bad", [
    {"energy_min": 0}, {"energy_min": 5, "energy_max": 1}, {"mt_mode": "x"}, {"mt_mode": "custom"}, {"z_threshold": 0}, {"tiers": ["F"]}])
def test_selection_rejects(bad):
    with pytest.raises(ValueError):
        select.Selection(**bad)


def test_excluded_reactions_in_every_mode():
    assert select.Selection(exclude_mt=[18]).mt_codes() == [2, 4, 16, 102, 103, 107]
    assert select.Selection(mt_mode="custom", custom_mt=[1, 9001], exclude_mt=[9000]).mt_codes() == [1]
    assert select.Selection(mt_mode="all_physical").mt_codes() is None


def test_predicates_reach_the_scan(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    tables.write_measurements(frame, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    wanted = select.Selection(projectile="all", energy_min=10, energy_max=1e6, exclude_spectrum_averaged=False)
    plan = tables.load_measurements(spark, path, wanted, columns=["Z", "Energy"])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(Energy,10.0)" in plan and "In(MT" in plan
    assert "Entry" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_partitioned_write_and_swap(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    tables.write_measurements(frame, path, ["Z"])
    assert spark.read.parquet(path).count() == 200
    tables.replace_with(spark.read.parquet(path).filter("Z = 1"), path, spark)
    assert spark.read.parquet(path).select("Z").distinct().collect() == [(1,)]
    assert tables.partition_report(frame, ["Z"]).first().partitions == 3


def test_spectrum_filter_reads_compound_codes(frame):
    kept = select.drop_spectrum_averaged(frame).select("sf8").distinct().collect()
    assert {r.sf8 for r in kept} == {None, "REL", "RAW"}


def test_normalize_and_quality(spark):
    raw = spark.createDataFrame([(1, 2, 18, 1.0, 2.0, float("nan")), (1, 0, 18, 1.0, 2.0, 0.1), (1, 3, 18, -1.0, 2.0, 0.1), (1, 3, 18, 1.0, None, 0.1),
                                 (1, 3, 18, float("inf"), 1.0, 0.1)], "target_z int, A int, MT int, En double, Data double, dData double")
    rows = quality.quality_filter(quality.normalize(raw)).collect()
    assert len(rows) == 1 and rows[0].Uncertainty is None and rows[0].Entry == "UNKNOWN" and rows[0].N == 1
    with pytest.raises(ValueError):
        quality.normalize(raw.drop("En"))
    with pytest.raises(ValueError):
        quality.require_rows(raw.limit(0))


def test_payload_edge_cases(spark):
    meta = spark.createDataFrame([("a", 92, "U-235", "n", 18), ("b", 1, "H-1", "n", 2), ("c", 1, "H-NAT", "n", 2)], "DatasetID string, zTarg1 int, Targ1 string, Proj string, MT int")
    payload = spark.createDataFrame([
        ("a", '{"c5data":{"x1":{"x1":[1,2,3]},"y":{"y":[5,6],"dy":[0.5]}}}'), ("b", "not json"), ("c", '{"c5data":{"x1":{"x1":[1]},"y":{"y":[1]}}}')], "DatasetID string, jx5z string")
    rows = points.nested_payload_points(meta, payload).orderBy("En").collect()
    assert [(r.A, r.En, r.dEn, r.Data, r.dData) for r in rows] == [(235, 1.0, None, 5.0, 0.5), (235, 2.0, None, 6.0, None)]
    with pytest.raises(ValueError):
        points.nested_payload_points(meta.filter("DatasetID = 'b'"), payload, require=True)
    with pytest.raises(ValueError):
        points.extract_points({"x": meta.select("DatasetID")})


def test_structure_line(spark):
    line = "235 0921" + " " * 61 + "703.8".rjust(9) + "My" + " " * 8 + "(7/2-)*".ljust(14)
    row = fixed_width.structure_table(spark.createDataFrame([(line,), ("#" + line[1:],)], "value string")).collect()
    assert [(r.Z, r.A, r.Spin, r.Parity, r.Isomer_Level) for r in row] == [(92, 235, 3.5, -1, 1)]
    assert row[0].Half_Life_s == pytest.approx(703.8e6 * 31557600)


@pytest.mark.parametrize("text, want", [("1/2+*", (0.5, 1)), ("0+", (0.0, 1)), ("(5/2+)", (2.5, 1)), ("T=1", (None, None)), ("", (None, None)), ("high", (None, None)), ("3-", (3.0, -1))])
def test_spin_parity(spark, text, want):
    spin, parity = S.spin_parity(F.lit(text))
    assert tuple(spark.range(1).select(spin, parity).first()) == want


def test_reaction_text(spark):
    codes = spark.createDataFrame([("92-U-235(N,F),,SIG,,REL,EXP",), ("(1-H-1(N,EL)),CUM,DA",), ("x",)], "c string")
    rows = codes.select(*[e.alias(n) for n, e in S.reaction_fields("c").items()]).collect()
    assert tuple(rows[0]) == (None, "SIG", "REL", "EXP") and rows[2] == (None, None, None, None)


def test_labels(spark):
    row = spark.range(1).select(L.mt_name(F.lit(51)), L.mt_name(F.lit(92)), L.mt_category(F.lit(110)), L.nuclide_label(F.lit(92), F.lit(235)), L.projectile_name(F.lit("HE3"))).first()
    assert tuple(row) == ("(n,n₁) - 1st excited", "Unknown (MT 92)", "Other", "U-235", "³He")


@pytest.mark.parametrize("scaler, base", [("standard", 10), ("minmax", 10), ("minmax", "e"), ("minmax", 2), ("robust", 10), ("none", 10)])
def test_transform_round_trip(spark, frame, tmp_path, scaler, base):
    fitted = Scaler(TransformConfig(scaler=scaler, energy_log_base=base, log_base=base)).fit(frame, ["Energy", "CrossSection", "A"])
    fitted.save(spark, str(tmp_path / "s"))
    fitted = Scaler.load(spark, str(tmp_path / "s"))
    back = fitted.inverse(fitted.transform(frame)).toPandas()
    want = frame.toPandas()
    assert np.allclose(back.Energy, want.Energy) and np.allclose(back.CrossSection, want.CrossSection)
    target = frame.select(fitted.inverse_target(fitted.target("CrossSection")).alias("t"), "CrossSection").toPandas()
    assert np.allclose(target.t, target.CrossSection)


def test_scaler_without_spread_or_values(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    for scaler in ("standard", "minmax", "robust"):
        fitted = Scaler(TransformConfig(scaler=scaler, log_energy=False)).fit(df, ["a", "b"])
        assert fitted.scale == {"a": 1.0, "b": 1.0} and fitted.shift["b"] == 0.0
    with pytest.raises(RuntimeError):
        Scaler().transform(df)


@pytest.mark.parametrize("missing", ["median", "equal", "exclude"])
def test_weights(frame, missing):
    got = weights.add_sample_weights(frame, "xs", missing).toPandas()
    raw = 1 / got.Uncertainty**2
    filled = {"median": raw.fillna(raw.median()), "equal": raw.fillna(1.0), "exclude": raw}[missing]
    capped = np.minimum(filled, np.nanpercentile(filled, 99))
    assert np.allclose(got.weight, capped / np.nanmean(capped), equal_nan=True)
    assert weights.add_sample_weights(frame.drop("Uncertainty")).filter("weight IS NOT NULL").count() == 0


def test_enrichment_keeps_rows(spark, frame):
    ref = spark.createDataFrame([(92, 235, 40000.0, 1.0, 7.0, 5000.0, 0), (92, 235, 40001.0, 1.0, 7.0, 5000.0, 1)],
                                "Z int, A int, Mass_Excess_keV double, Binding_Energy_keV double, Binding_Per_Nucleon_keV double, S_1n_keV double, Isomer_Level int")
    rows = reference.enrich(frame, ref, ["A", "C"])
    assert rows.count() == 200 and reference.enrich(frame, ref, ["A"]) is frame
    out = features.tier_features(rows, ["A", "B", "C"])
    assert out.columns == sorted(out.columns) and "S_1n_MeV" in out.columns and "Mass_Excess_keV" not in out.columns
    with pytest.raises(ValueError):
        reference.enrich(frame, ref.drop("Isomer_Level"), ["C"])


def test_formula_mass(spark):
    got = spark.range(1).select(S.binding_energy_mev(F.lit(26), F.lit(56))).first()[0]
    assert got == pytest.approx(15.75 * 56 - 17.8 * 56 ** (2 / 3) - 0.711 * 26**2 / 56 ** (1 / 3) - 23.7 * 16 / 56 + 11.18 / math.sqrt(56))


def test_row_and_null_classification(spark):
    df = spark.createDataFrame([(" none ", "SIG", "brs/rel", "EXP"), (None, None, None, None), ("CUM", "SIG", None, "CALC"), (None, "RAT", None, None)], "sf5 string, sf6 string, sf8 string, sf9 string")
    rows = classify.classify(classify.clean_sf(df)).collect()
    assert [(r.data_type, r.is_pure) for r in rows] == [("relative", False), ("absolute", True), ("calculated", False), ("ratio", False)]


def test_derivative_excess_counts_equal_energies(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 2.0, 3.0)], "k int, x double, y double")
    assert evaluate.derivative_excess(df, ["k"], "x", "y", 100.0).first().excess == pytest.approx((1e10 - 100) / 2)


def test_clean_stream_matches_batch(spark, frame, tmp_path):
    from crossfield.streaming.stateless import clean_stream

    raw = frame.withColumns({c: F.lit(None).cast("string") for c in ("sf5", "sf6", "sf9")})
    raw.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(map(str, df.select("Entry", "Energy", "data_type", "out_n", "kR").collect()))
    assert key(spark.table("cleaned")) == key(clean_stream(raw))


@pytest.mark.parametrize("cell", [100_000, 1])
def test_split_tables_pair_every_energy_with_every_value(spark, monkeypatch, cell):
    from crossfield.plans import scale
    from crossfield.sources.points import split_table_points

    monkeypatch.setattr(scale, "CELL_ROWS", cell)

    reactions = spark.createDataFrame([(1, "E1", 92, 235, 18), (2, "E2", 1, 1, 2)], "id int, entry_id string, target_z int, target_a int, mt int")
    side = lambda rows: spark.createDataFrame(rows, "reaction_id int, value double")
    out = split_table_points(reactions, side([(1, 1.0), (1, 2.0), (2, 5.0), (2, None)]), side([(1, 10.0), (1, 20.0), (2, 7.0)]), side([(1, 0.5)]))
    got = sorted((r["entry_id"], r["energy"], r["xs"], r["dxs"]) for r in out.collect())
    assert got == [("E1", e, x, 0.5) for e in (1.0, 2.0) for x in (10.0, 20.0)] + [("E2", 5.0, 7.0, None)]


@pytest.mark.parametrize("options", [{"cell": 1}, {"cell": 100_000}, {"cell": 100_000, "unique_ids": True}])
def test_nested_payloads_join_every_dataset_row(spark, monkeypatch, options):
    from crossfield.plans import scale
    from crossfield.sources.points import nested_payload_points

    monkeypatch.setattr(scale, "CELL_ROWS", options.pop("cell"))
    meta = spark.createDataFrame([("a", 26, "Fe-56", "n", 18), ("a", 27, "Co-59", "n", 18), ("b", 1, "H-1", "p", 2), ("c", 1, "H-1", "p", 2)],
                                 "DatasetID string, zTarg1 int, Targ1 string, Proj string, MT int")
    body = '{"c5data": {"x1": {"x1": [1.0, %s]}, "y": {"y": [5.0, 6.0]}}}'
    payload = spark.createDataFrame([("a", body % "2.0"), ("a", body % "3.0"), ("b", body % "4.0"), ("d", body % "9.0")], "DatasetID string, jx5z string")
    got = sorted((r["DatasetID"], r["Z"], r["En"], r["Data"]) for r in nested_payload_points(meta, payload, **options).collect())
    assert got == sorted([("a", z, e, d) for z in (26, 27) for e2 in (2.0, 3.0) for e, d in ((1.0, 5.0), (e2, 6.0))] + [("b", 1, 1.0, 5.0), ("b", 1, 4.0, 6.0)])


def test_a_computed_line_is_made_once(spark):
    """Rules and fields read the line many times; the plan holds the expression that makes it once."""
    text = spark.createDataFrame([(" 12 Xx   6 " + "        1.25      1.00" * 6,), (None,)], "value string")
    lines = text.select(F.format_string("%s", "value").alias("value"))
    parsers = [fixed_width.mass_table, fixed_width.structure_table, fixed_width.whitespace_mass_table,
               lambda df: fixed_width.reaction_energy_table(df, fixed_width.REACTION_ENERGY_1)]
    for parse in parsers:
        assert parse(lines)._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 1
    assert parsers[-1](lines).first()[:3] == (6, 12, 1.25)


def test_totals_of_a_hot_dataset_need_no_pairs(spark, monkeypatch):
    """2,000 points under an id with 30 metadata rows; the totals equal those over all pairs."""
    meta = spark.createDataFrame([(i if i < 5 else -1, i % 4 + 1, "X-7", "n", 18) for i in range(35)], "DatasetID long, zTarg1 int, Targ1 string, Proj string, MT int")
    flat = spark.createDataFrame([(i % 7 if i % 3 == 0 else -1, float(i), None if i % 5 == 0 else i / 8, 0.5) for i in range(3000)], "DatasetID long, x1 double, y double, dy double")
    pairs = points.flat_points(meta, flat)
    want = pairs.groupBy("Z").agg(F.count(F.lit(1)), F.sum("En"), F.sum("Data")).orderBy("Z").collect()
    found = points.flat_point_totals(meta, flat, ["Z"])
    assert [tuple(r)[:4] for r in found.orderBy("Z").collect()] == [tuple(r) for r in want] and len(want) == 4
    joined = []
    original = points.join_datasets
    monkeypatch.setattr(points, "join_datasets", lambda *a, **k: joined.append(original(*a, **k)) or joined[-1])
    points.flat_point_totals(meta, flat, ["Z"]).count()
    assert joined[0].count() < pairs.count() / 5  # four values of Z for 30 rows of the hot id
