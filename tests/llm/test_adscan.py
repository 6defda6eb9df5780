"""Nearest vectors against brute force: exact scores and order, recall, lists that hold nearly all rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crossfield.llm import adscan
from tests.llm.vector_cases import one_per_id, rows, table, usable

K = 5


def brute(data, is_query):
    ok = one_per_id([(i, [float(np.float32(x)) for x in v]) for i, v, _ in data if i is not None and usable(v) and any(v)], lambda r: r[1])
    out = {}
    for i, v in ok:
        if is_query(i):
            others = [(j, o) for j, o in ok if j != i and len(o) == len(v)]
            if others:
                a, b = adscan.scaled(np.array([v])), adscan.scaled(np.array([o for _, o in others]))
                score = adscan.cosines(a, b)
                out[i] = sorted(zip((-score).tolist(), [j for j, _ in others]))[:K]
    return out


def ours(df, config=None):
    found = {}
    for r in adscan.nearest(df, F.col("id") % 50 == 0, config=config).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(x) for q, x in found.items()}


def recall(got, want):
    """Share of the true neighbours found; a row as near as the last of them counts too."""
    hit = total = 0
    for q, true in want.items():
        mine = got[q]
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        assert [(-s, j) for _, s, j in mine] == sorted((-s, j) for _, s, j in mine)
        total += len(true)
        hit += len({j for _, _, j in mine} & {j for _, j in true})
    assert set(got) == set(want)
    return hit / max(1, total)


def test_awkward_rows(spark):
    data = rows()
    want = brute(data, lambda i: i % 50 == 0)
    got = ours(table(spark, data))
    assert recall(got, want) >= 0.99
    scores = {(q, j): -s for q, true in want.items() for s, j in true}
    assert all(s == scores[q, j] for q, found in got.items() for _, s, j in found if (q, j) in scores)


def test_small_sample_small_blocks(spark):
    data = rows(seed=5, groups=8, each=60, copies=200)
    config = adscan.Scan(sample_rows=60, most_lists=12, least_lists=2, block_rows=16, chunk_rows=2)
    assert recall(ours(table(spark, data), config), brute(data, lambda i: i % 50 == 0)) >= 0.95


def test_one_list_of_copies_is_spread(spark):
    data = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(400)] + [(400 + i, [float(i), 1.0, -2.0, 0.5], 1) for i in range(30)]
    config = adscan.Scan(sample_rows=40, block_rows=32, chunk_rows=4)
    got = ours(table(spark, data), config)
    assert [j for _, _, j in got[50]] == [0, 1, 2, 3, 4] and [j for _, _, j in got[0]] == [1, 2, 3, 4, 5]
    assert recall(got, brute(data, lambda i: i % 50 == 0)) == 1.0


def test_no_rows(spark):
    assert ours(table(spark, [])) == {} and ours(table(spark, [(50, None, 1), (100, [0.0, 0.0], 1)])) == {}
    assert ours(table(spark, [(50, [1.0, 2.0], 1)])) == {}


def test_tests_abandon_pairs_early():
    r = np.random.default_rng(0)
    x = r.standard_normal((800, 64))
    q = x[:40] + 0.05 * r.standard_normal((40, 64))
    x, q = (adscan.rotated(v, 7) for v in (x, q))
    limit = np.full(40, 0.02)
    a, b = adscan.surviving(q, x, limit, adscan.Scan())
    assert set(zip(range(40), range(40))) <= set(zip(a.tolist(), b.tolist())) and len(a) < 60


@pytest.mark.parametrize("sample_rows", [80, 300, 1000])
def test_recall_on_the_given_vectors(spark, sample_rows):
    data = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = data["vec_id"].to_pylist(), data["embedding"].to_pylist()
    want = brute([(i, v, 0) for i, v in zip(ids, vectors)], lambda i: i % 50 == 0)
    config = adscan.Scan(sample_rows=sample_rows)
    got = ours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), config)
    share = recall(got, want)
    print(sample_rows, share)
    assert share >= 0.9
