"""Hard negatives against a brute-force version; residue arithmetic against Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfield.llm import residues
from tests.llm.vector_cases import one_per_id, rows, table, usable


def brute(data, positives=5, negatives=3):
    ok = []
    for i, v, label in data:
        if i is None or label is None or not usable(v):
            continue
        c = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in c) < 2**60:
            ok.append((i, c, (label + 1) % 10 if i % 7 == 0 else label))
    ok = one_per_id(ok, lambda r: (r[1], r[2]))
    out = []
    for i, c, label in ok:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(c, o)), j, m) for j, o, m in ok if j != i and len(o) == len(c))
        for score, j, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(i, j, k + 1, s[1], -score, -s[0]) for k, s in enumerate(window)]
    return sorted(out)


def ours(df):
    label = F.col("label").cast("long")
    found = residues.mine(df, F.col("id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return sorted(tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equals_brute_force_on_awkward_rows(spark):
    data = rows()
    want = brute(data)
    assert len(want) > 20 and ours(table(spark, data)) == want


def test_small_blocks_and_slices_give_the_same(spark, monkeypatch):
    data = rows(seed=3)
    for name, value in (("BLOCK_ROWS", 16), ("CHUNK_ROWS", 2), ("SLICE_ROWS", 2), ("SMALL_BLOCK", 16)):
        monkeypatch.setattr(residues, name, value)
    assert ours(table(spark, data)) == brute(data)


def test_no_rows(spark):
    assert ours(table(spark, [])) == [] and ours(table(spark, [(50, [1.0, 2.0], 1)])) == []


@pytest.mark.parametrize("size,length", [(3, 1), (200, 64), (200, 200), (2**20, 64), (2**26, 64), (2**29, 2)])
def test_scores_are_exact(size, length):
    r = np.random.default_rng(size)
    left, right = r.integers(-size, size + 1, (300, length)), r.integers(-size, size + 1, (40, length))
    left[0], right[0], right[1] = size, size, -size
    found = np.concatenate([s for _, s in residues.scores(left, right)])
    assert found.tolist() == (left.astype(object) @ right.astype(object).T).tolist()


def test_sums_stay_exact_in_float32():
    for prime in residues.primes(2**70):
        assert residues.EXACT // (prime // 2) ** 2 * (prime // 2) ** 2 <= residues.EXACT
