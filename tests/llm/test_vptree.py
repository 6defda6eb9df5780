"""Clustering against a brute-force version, ties and bounds of the tree."""

import hashlib
import math

import numpy as np
import pytest

from crossfield.llm import vptree
from tests.llm.vector_cases import rows, table, usable


def brute(data, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in data if usable(v) and len(v) == 64]
    kept = [(i, c) for i, c in kept if sum(x * x for x in c) < 2**58]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), c) for i, c in kept if i is not None)[:clusters]
    centroids = [c for _, c in seeds]

    def nearest(c):
        return min((sum((a - b) ** 2 for a, b in zip(c, m)), k) for k, m in enumerate(centroids))

    for _ in range(rounds):
        placed = [nearest(c)[1] for _, c in kept]
        for k in range(len(centroids)):
            mine = [c for (_, c), p in zip(kept, placed) if p == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *nearest(c)) for i, c in kept]
    of = {}
    for _, d, k in out:
        of[k] = of.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, of[k], sum(of.values()), sha[k]) for i, d, k in out), key=repr)


def ours(df):
    assigned, centroids = vptree.cluster(df)
    return sorted((tuple(r) for r in vptree.with_inertia(assigned, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_equals_brute_force_on_awkward_rows(spark):
    data = rows()
    assert ours(table(spark, data)) == brute(data)


def test_fewer_vectors_than_clusters(spark):
    data = rows(groups=1, each=9, copies=0)
    assert ours(table(spark, data)) == brute(data)


def test_no_vectors(spark):
    assert ours(table(spark, [])) == [] and ours(table(spark, [(1, None, 1), (2, [1.0], 2)])) == []


@pytest.mark.parametrize("seed", range(8))
def test_tree_search_is_exact_with_ties(seed):
    r = np.random.default_rng(seed)
    centroids = r.integers(-3, 4, (1 + 5 * seed, 2))             # many equal distances and equal centroids
    vectors = np.concatenate([r.integers(-5, 6, (300, 2)), r.integers(-2**27, 2**27, (20, 2))])
    who, best = vptree.nearest(vptree.build(centroids), vectors)
    for v, k, d in zip(vectors.tolist(), who, best):
        assert (d, k) == min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids.tolist()))


def test_search_leaves_out_far_subtrees(monkeypatch):
    centroids = np.array([[1000 * k, 0] for k in range(16)])
    seen = []
    measure = vptree.squared_distances
    tree = vptree.build(centroids)
    monkeypatch.setattr(vptree, "squared_distances", lambda v, c: seen.append(len(v)) or measure(v, c))
    vptree.nearest(tree, np.array([[3001, 2]] * 100))
    assert sum(seen) < 100 * 16 // 2
