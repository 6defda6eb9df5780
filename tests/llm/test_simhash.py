import pytest
from cases import TABLES, nothing, prose, shingles, simhash, tricky, tricky_rows, union
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crossfield.llm import simhash as op
from crossfield.llm.common import spread_join
from crossfield.llm.components import components


def linked(prints, bits=3):
    ids = sorted(prints)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= bits]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: simhash(r["text"]) for r in docs}
    want = union(prints, linked(prints))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.queries()["op3_simhash"](spark, TABLES).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


@pytest.mark.parametrize("tile_rows", [4096, 3])
def test_no_link_is_lost_whatever_the_tiles(spark, tile_rows):
    import random

    r = random.Random(5)
    prints = {}
    for c in range(12):
        center = r.getrandbits(64)
        for _ in range(14):
            x = center
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            prints[len(prints)] = x
    rows = [(d, p - 2**64 if p >= 2**63 else p) for d, p in prints.items()]
    found = op.cluster(spark.createDataFrame(rows, "doc_id long, fingerprint long"), tile_rows=tile_rows)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == union(prints, linked(prints))


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in tricky_rows()]
    got = op.cluster(op.fingerprints(tricky(spark))).collect()
    assert len(got) == len(rows)
    known = {d: simhash(t) for d, t in rows if d is not None}
    want = union(known, linked(known))
    for row in got:
        if row["doc_id"] is not None:
            assert row["fingerprint"] % 2**64 == known[row["doc_id"]] and row["component_id"] == want[row["doc_id"]]
        else:
            assert row["component_id"] in (0, 3)  # of the base text, and of the texts without words
    assert op.cluster(op.fingerprints(nothing(spark))).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    base = prose(9, 400)
    parts = base.split()
    copies = [(0, base), (3, base), (3, base)]
    copies += [(10 + k, " ".join(parts[:40 * k] + ["edit"] + parts[40 * k + 1:])) for k in range(1, 9)]
    clean = [(100 + k, prose(200 + k, 60)) for k in range(20)]
    df = spark.createDataFrame(copies + clean, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in op.dedup(df).collect()) == [0, *[d for d, _ in clean]]
    assert op.dedup(df, tile_rows=2).count() == 21


def test_dedup_on_awkward_rows(spark):
    df = tricky(spark)
    got = op.dedup(df)
    assert got.columns == df.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=lambda d: (d is None, d))
    assert 0 in ids and 1 not in ids and 2 not in ids and ids.count(5) == 1 and 6 not in ids and ids.count(3) == 1 and None not in ids
    assert op.dedup(nothing(spark)).count() == 0


def test_similar_pairs_are_found_and_others_left(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: set(shingles(r["text"], 5)) for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in op.near_copies(docs).collect()}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] or sets[b]):
                similar = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                assert similar < 0.9 or got[a] == got[b]
                assert similar > 0.6 or got[a] != got[b] or got[a] not in (a, b)


def ending_anew(seed, fresh):
    """A text of 100 words, and one whose last words are others: Jaccard (96 - fresh) / (96 + fresh)."""
    old, new = prose(seed, 100).split(), prose(seed + 5000, 100).split()
    return " ".join(old), " ".join(old[:100 - fresh] + [f"new{w}" for w in new[:fresh]])


def test_pairs_at_the_limit_are_decided_exactly(spark):
    rows, near = [], {}
    for k in range(120):
        a, b = ending_anew(3000 + k, 10 if k % 2 else 11)  # 0.811 and 0.794
        sa, sb = set(shingles(a, 5)), set(shingles(b, 5))
        near[k] = len(sa & sb) / len(sa | sb) >= 0.8
        rows += [(2 * k, a), (2 * k + 1, b)]
    assert sum(near.values()) == 60
    got = {r["doc_id"]: r["component_id"] for r in op.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[2 * k + 1] == 2 * k for k in near} == near


def test_repeats_of_a_line_do_not_part_near_copies(spark):
    rows = []
    for k in range(40):
        text = prose(4000 + k, 400)
        rows += [(2 * k, text), (2 * k + 1, text + ("\n" + text.split("\n")[0]) * 20)]
    for a, b in zip(rows[::2], rows[1::2]):
        sa, sb = set(shingles(a[1], 5)), set(shingles(b[1], 5))
        assert len(sa & sb) / len(sa | sb) >= 0.9
    got = {r["doc_id"]: r["component_id"] for r in op.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 100 != 99], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)}


@pytest.mark.parametrize("centre", [0, 10**6])
def test_components_of_a_star(spark, centre):
    """The centre is the smallest or the largest node; every leaf has one more neighbour."""
    star = spark.range(1, 20_001).select(F.lit(centre).alias("a"), F.col("id").alias("b"))
    links = star.union(star.select("b", (F.col("b") + 2 * 10**6).alias("a")))
    found = components(links)
    row = found.agg(F.count("node"), F.countDistinct("node"), F.min("root"), F.max("root")).first()
    assert tuple(row) == (40_001, 40_001, min(centre, 1), min(centre, 1))


def test_hot_keys_stay_where_their_rows_are(spark):
    rows = spark.range(0, 9000, 1, 30).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    facts = rows.groupBy(F.col("k").alias("f")).agg(F.count(F.lit(1)).alias("n")).filter("f % 7 <> 3").withColumn("fact", F.col("f") * 2)
    want = sorted(map(tuple, rows.join(facts, F.col("k") == F.col("f")).select("i", "fact").collect()))
    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in settings}
    try:
        for n, value in settings.items():
            spark.conf.set(n, value)
        out = spread_join(rows, facts, "k", "f", "n", 9000)
        assert out.columns == ["k", "i", "f", "fact"] and sorted(map(tuple, out.select("i", "fact").collect())) == want
        tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert tasks[-1] <= 2.5 * tasks[len(tasks) // 2]
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
