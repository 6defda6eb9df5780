from collections import defaultdict

from cases import TABLES, nothing, tricky, tricky_rows, words
from oracle_check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crossfield.llm import mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: weight[s] * left / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op7_mixing"](spark, TABLES), connect(TABLES), entry.oracle_sql()["op7_mixing"]) is None


def test_targets_and_totals(spark):
    rows = [(i, f"s{i % 7 if i % 2 else 0}", 5 + i * 37 % 90) for i in range(2000)] + [(9000, "tiny", 3), (9001, None, 40), (9002, "void", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(5)
    got = mixing.mix(df, F.col("n")).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * max(n for _, o, n in rows if o == s)
    again = mixing.mix(df.repartition(2), F.col("n")).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}


def test_awkward_rows(spark):
    df = tricky(spark)
    got = mixing.mix(df, mixing.word_count("text"))
    assert {"extra"} == {r["cut"] for r in got.withColumn("cut", F.lit("extra")).collect()}
    assert sorted(r["size"] for r in got.collect()) == sorted(len(words(r[1])) for r in tricky_rows())
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns and {r["size"] for r in out.collect()} == {"extra"}
    assert mixing.stage(spark, nothing(spark), "").count() == 0
