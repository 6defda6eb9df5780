"""Small embedding tables with the awkward cases."""

import math

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int, id string, list int, rank string, components double, score int"


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def rows(seed=1, groups=6, each=40, length=64, copies=30):
    """Loose clusters, groups of copies, ties, and rows that take no part."""
    r = np.random.default_rng(seed)
    out, at = [], 0
    for _ in range(groups):
        centre = r.standard_normal(length)
        for _ in range(each):
            v = np.float32(centre + r.standard_normal(length) * r.choice([0.1, 0.7, 1.5]))
            out.append((at, v.tolist(), int(r.integers(0, 4))))
            at += 1
    copy = out[3][1]
    for _ in range(copies):
        out.append((at, copy, int(r.integers(0, 4))))
        at += 1
    out.append((at, (np.array(copy) * 2).tolist(), 1))          # same direction, another length
    out.append((at + 1, (-np.array(copy)).tolist(), 1))
    out += [(5, out[5][1], out[5][2]), (7, out[9][1], 2)]        # a repeated row, an id with two vectors
    bad = [None, [], [0.0] * length, [None] + [1.0] * (length - 1), [math.nan] * length, [math.inf] + [0.0] * (length - 1)]
    out += [(1000 + 50 * i, v, 1) for i, v in enumerate(bad)]
    out += [(None, copy, 1), (2000, copy, None), (2050, [1e30] * length, 2), (2100, [1e-42] * length, 2)]
    out += [(3000 + 25 * i, r.standard_normal(3).tolist(), i % 2) for i in range(5)]  # another length
    return out


def table(spark, data):
    return spark.createDataFrame([(*d, "extra", -1, None, 0.5, 9) for d in data], SCHEMA).repartition(5)


def one_per_id(data, key):
    """Of the rows sharing an id, the least by ``key``."""
    best = {}
    for row in data:
        if row[0] not in best or key(row) < key(best[row[0]]):
            best[row[0]] = row
    return [best[i] for i in sorted(best)]
