"""Nearest vectors by cosine: inverted lists scanned with adaptive dimension tests.

Vectors are scaled to length one and turned by a random rotation, which spreads a difference
evenly over the dimensions; nearness is then squared Euclidean distance.

* Fit. On a bounded sample (``sample_rows`` vectors of each length, drawn by a hash of the id)
  k-means gives the lists' centroids; centroids, rotation seed and sample are sent to the tasks.
  Every row is then put into the list of its nearest centroid.
* Probing. A query's distance to its k-th nearest row of the sample is an upper limit of its
  k-th distance, and these k rows are its first candidates. For a list, the share of rows within the limit follows from the distance to
  its centroid and its spread, residuals being directed at random; lists are probed until the
  rows expected in all others are at most ``miss`` of those expected in all, and the
  ``least_lists`` nearest ones always.
* Scan. A list's rows are dealt to blocks and the queries that probe it to chunks; they meet in
  a grid of tasks, so a list that holds most rows (copies, a hot cluster) is spread like any
  other. A block keeps its vectors in column blocks of ``columns`` dimensions. After each, the
  partial distance is tested against the limit: under the hypothesis that a row is within it,
  the partial distance exceeds limit * d / D * (1 + epsilon / sqrt(d))**2 with a small probability,
  and such a pair is abandoned. Columns are multiplied as matrices while many pairs live,
  afterwards only for the pairs that do.
* Survivors are measured exactly: the cosine of the original vectors in double precision decides.

What can be missed lies in lists not probed or failed a test; tests/llm/test_adscan.py measures
recall against brute force, README has the figures.

Defined results: vectors that are null or empty, zero, or hold null or non-finite components
take no part, nor do rows without an id (they cannot be named). Of rows that share an id the
one with the smallest vector counts. Only vectors of equal length are compared; every length
has an index of its own, so their number is taken to be small. Equal scores go by the smaller
id; a query with fewer than ``k`` candidates gets all of them. An empty table gives an empty
result. Only the named columns are read, others never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield.llm.common import materialize
from crossfield.llm.registry import register
from crossfield.llm.vectors import finite, first_of_each, matrix, one_row_per_id
from crossfield.plans.scale import attach

# Absolute slack of a squared distance between unit vectors in float32.
SLACK = 1e-5
# Pairs measured exactly at once, and rows of a batch compared with the sample at once.
PAIRS, ROWS = 32_768, 512
# Columns are multiplied as matrices while more than this share of the pairs is alive.
DENSE = 0.2


@dataclass(frozen=True)
class Scan:
    k: int = 5
    sample_rows: int = 16_384
    most_lists: int = 1024
    least_lists: int = 8
    miss: float = 0.02
    epsilon: float = 2.1
    columns: int = 8
    block_rows: int = 256
    chunk_rows: int = 1024
    rounds: int = 10
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Of one vector length: sample (rotated and original) with its ids, and centroids."""

    sample: np.ndarray
    original: np.ndarray
    ids: np.ndarray
    centroids: np.ndarray


@lru_cache(maxsize=4)
def rotation(length: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((length, length)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return (unit @ rotation(vectors.shape[1], seed)).astype(np.float32)


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    inner = left @ right.T
    lengths = np.einsum("ij,ij->i", left, left)[:, None] + np.einsum("ij,ij->i", right, right)[None, :]
    return np.maximum(lengths - 2 * inner, 0)


def fit(vectors: np.ndarray, ids: np.ndarray, rows: int, config: Scan) -> Model:
    """Centroids of about the square root of ``rows`` lists, by Lloyd's steps over the sample."""
    order = np.argsort(ids, kind="stable")
    original, ids = scaled(vectors[order]), ids[order]
    sample = rotated(original, config.seed)
    distinct = np.unique(sample, axis=0)
    lists = max(1, min(config.most_lists, round(math.sqrt(rows)), len(distinct) // 4))
    picked = np.random.default_rng(config.seed).choice(len(distinct), lists, replace=False)
    centroids = distinct[picked]
    for _ in range(config.rounds):
        nearest = squared_distances(sample, centroids).argmin(axis=1)
        met, where = np.unique(nearest, return_inverse=True)
        total = np.zeros((len(met), sample.shape[1]))
        np.add.at(total, where, sample)
        centroids = centroids.copy()
        centroids[met] = total / np.bincount(where)[:, None]
    return Model(sample, original, ids, centroids)


_NEAR = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
_GRID = np.linspace(-8, 8, 3201)
_NORMAL = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _GRID])


def expected_rows(away: np.ndarray, limit: np.ndarray, length: int, count: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Rows of each list expected within each query's limit; ``away`` are squared distances to the centroids."""
    share = np.zeros(away.shape)
    for step, weight in ((-1.2, 0.3), (0.0, 0.4), (1.2, 0.3)):
        radius = np.maximum(mean + step * spread, 1e-6)[None, :]
        over = (away + radius**2 - limit[:, None]) / np.maximum(2 * np.sqrt(away) * radius, 1e-6)
        share += weight * np.interp(-over * math.sqrt(length), _GRID, _NORMAL)
    return share * count[None, :]


def probes(away: np.ndarray, expected: np.ndarray, limit: np.ndarray, config: Scan) -> np.ndarray:
    """Mask of the lists each query looks at."""
    order = np.argsort(-expected, axis=1, kind="stable")
    ordered = np.take_along_axis(expected, order, axis=1)
    missed = ordered.sum(axis=1, keepdims=True) - np.cumsum(ordered, axis=1) + ordered  # before the list is taken
    taken = np.zeros(expected.shape, bool)
    np.put_along_axis(taken, order, missed > config.miss * ordered.sum(axis=1, keepdims=True), axis=1)
    near = np.argsort(away, axis=1, kind="stable")[:, :config.least_lists]
    np.put_along_axis(taken, near, True, axis=1)
    return taken | ~np.isfinite(limit)[:, None]


def surviving(queries: np.ndarray, rows: np.ndarray, limit: np.ndarray, config: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test abandons, one block of columns after another."""
    length = rows.shape[1]
    blocks = [(s, min(s + config.columns, length)) for s in range(0, length, config.columns)]
    stored = [np.ascontiguousarray(rows[:, a:b].T) for a, b in blocks]

    def bar(d: int) -> np.ndarray:
        loose = (1 + config.epsilon / math.sqrt(d)) ** 2 * d / length if d < length else 1.0
        return limit * loose + SLACK

    partial = np.zeros((len(queries), len(rows)), np.float32)
    alive = np.ones(partial.shape, bool)
    done = 0
    for (a, b), block in zip(blocks, stored, strict=True):
        part = queries[:, a:b]
        partial += np.einsum("ij,ij->i", part, part)[:, None] + np.einsum("ij,ij->j", block, block)[None, :] - 2 * (part @ block)
        done += 1
        alive &= partial <= bar(b)[:, None]
        if alive.mean() < DENSE:
            break
    q, r = np.nonzero(alive)
    distance = partial[q, r]
    for (a, b), block in zip(blocks[done:], stored[done:], strict=True):
        apart = queries[q, a:b] - block[:, r].T
        distance += np.einsum("ij,ij->i", apart, apart)
        lives = distance <= bar(b)[q]
        q, r, distance = q[lives], r[lives], distance[lives]
    return q, r


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, the same for equal vectors wherever they stand."""
    inner, a, b = (x.sum(axis=1) for x in (left * right, left * left, right * right))
    return inner / (np.sqrt(a) * np.sqrt(b))


def _unpack(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    rows = column.combine_chunks().cast(pa.large_binary())
    return np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(len(rows), -1)


def _pack(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(vectors)], pa.binary())


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for length in np.unique(table["length"].to_numpy()).tolist():
            part = table.filter(pa.compute.equal(table["length"], length))
            for start in range(0, len(part), ROWS):
                yield length, part.slice(start, ROWS)


def scan(rows: pa.Table, queries: pa.Table, config: Scan) -> pa.Table:
    """The first ``k`` rows of a block for each query of a chunk, among those within its limit."""
    rows = rows.sort_by("id")
    ids, asked = rows["id"].to_numpy(), queries["id"].to_numpy()
    q, r = surviving(_unpack(queries["turned"], np.float32), _unpack(rows["turned"], np.float32), queries["reach"].to_numpy(), config)
    others = ids[r] != asked[q]
    q, r = q[others], r[others]
    left, right = _unpack(queries["original"], np.float64), _unpack(rows["original"], np.float64)
    score = np.concatenate([np.zeros(0), *(
        cosines(left[q[s:s + PAIRS]], right[r[s:s + PAIRS]]) for s in range(0, len(q), PAIRS))])
    order = np.lexsort((r, -score, q))
    order = order[first_of_each(q[order], config.k)]
    return pa.table({"query_id": asked[q[order]], "vec_id": ids[r[order]], "score": score[order]})


def nearest(
    df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", config: Scan | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that meets ``is_query`` (a condition on ``id``)."""
    config = config or Scan()
    spark = df.sparkSession
    usable = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    rows = df.filter(usable & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("length"))
    sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = spark.sparkContext.broadcast(_models(rows, sizes, config))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, part in _by_length(batches):
            original = scaled(matrix(part["vector"]))
            turned = rotated(original, config.seed)
            away = squared_distances(turned, models.value[length].centroids)
            home = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part["id"].combine_chunks(), part["length"].combine_chunks(), pa.array(home, pa.int32()),
                 pa.array(np.sqrt(away[np.arange(len(home)), home]).astype(float)), _pack(turned), _pack(original)],
                ["id", "length", "list", "radius", "turned", "original"])

    placed = materialize(one_row_per_id(rows, "id", "length", "vector").mapInArrow(
        place, "id long, length int, list int, radius double, turned binary, original binary"), "placed")
    # One row for each list: at most ``most_lists`` of each length.
    lists = placed.groupBy("length", "list").agg(
        F.count(F.lit(1)).alias("n"), F.avg("radius").alias("mean"), F.coalesce(F.stddev_pop("radius"), F.lit(0.0)).alias("spread"))
    lists = materialize(lists, "lists")
    spreads: dict[int, np.ndarray] = {}
    for r in lists.toLocalIterator():
        table = spreads.setdefault(r["length"], np.zeros((3, len(models.value[r["length"]].centroids))))
        table[:, r["list"]] = r["n"], r["mean"], r["spread"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, part in _by_length(batches):
            model, turned = models.value[length], _unpack(part["turned"], np.float32)
            ids = part["id"].to_numpy()
            distance = squared_distances(turned, model.sample)
            distance[ids[:, None] == model.ids[None, :]] = np.inf
            limit = np.full(len(ids), np.inf)
            first = np.argpartition(distance, min(config.k, len(model.ids)) - 1, axis=1)[:, :config.k]
            if first.shape[1] == config.k:
                limit = np.take_along_axis(distance, first, axis=1).max(axis=1).astype(float)
            original = _unpack(part["original"], np.float64)
            near = [[{"vec_id": int(model.ids[j]), "score": c} for j, c in zip(js, cosines(original[i][None, :], model.original[js]).tolist(), strict=True)
                     if model.ids[j] != ids[i]] for i, js in enumerate(first)]
            away = squared_distances(turned, model.centroids).astype(float)
            finite_limit = np.where(np.isfinite(limit), limit, 4.0)
            expected = expected_rows(away, finite_limit, length, *spreads[length])
            chosen = [np.flatnonzero(row).tolist() for row in probes(away, expected, limit, config)]
            yield pa.RecordBatch.from_arrays(
                [part["id"].combine_chunks(), part["length"].combine_chunks(), pa.array(finite_limit), pa.array(chosen, pa.list_(pa.int32())), pa.array(near, _NEAR),
                 part["turned"].combine_chunks(), part["original"].combine_chunks()],
                ["id", "length", "reach", "lists", "near", "turned", "original"])

    asked = materialize(placed.filter(is_query).mapInArrow(
        probe, "id long, length int, reach double, lists array<int>, near array<struct<vec_id: long, score: double>>, "
               "turned binary, original binary"), "asked")
    first = asked.select(F.col("id").alias("query_id"), F.explode("near").alias("n")).select("query_id", "n.vec_id", "n.score")
    asked = asked.select("id", "length", "reach", F.explode("lists").alias("list"), "turned", "original")

    by = ["length", "list"]
    grid = lists.join(asked.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), by).select(
        *by, F.ceil(F.col("n") / config.block_rows).cast("int").alias("blocks"), F.ceil(F.col("m") / config.chunk_rows).cast("int").alias("chunks"))
    grid = materialize(grid, "grid")

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        table = table.select(*[F.col(c).alias(c) for c in table.columns])  # both sides may come from one table
        return attach(table, grid, by, "inner").withColumns({
            own: F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))}).drop("blocks", "chunks")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(block: pa.Table, chunk: pa.Table) -> pa.Table:
        return scan(block, chunk, config).cast(schema) if len(block) and len(chunk) else schema.empty_table()

    cell = [*by, "block", "chunk"]
    found = dealt(placed.drop("radius"), "block", "chunk").groupBy(*cell).cogroup(
        dealt(asked, "chunk", "block").groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score double")
    # A row of the sample may be found twice, with the same score.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.union(first).withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= config.k).dropDuplicates(
        ["query_id", "vec_id"]).select("query_id", "rank", "vec_id", "score")


def _models(rows: DataFrame, sizes: dict[int, int], config: Scan) -> dict[int, Model]:
    """One model for each vector length, from at most about ``sample_rows`` rows of it."""
    if not sizes:
        return {}
    share = F.lit(None).cast("double")
    for length, n in sizes.items():
        share = F.when(F.col("length") == length, F.lit(min(1.0, config.sample_rows / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id", F.lit(config.seed)), F.lit(1 << 30)) < share * (1 << 30)
    table = one_row_per_id(rows.filter(drawn), "id", "length", "vector").toArrow()
    # A length of which the hash draws no row borrows one row of it.
    models = {}
    for length, n in sizes.items():
        part = table.filter(pa.compute.equal(table["length"], length))
        if not len(part):
            part = rows.filter(F.col("length") == length).limit(1).toArrow()
        models[length] = fit(matrix(part["vector"]), part["id"].to_numpy(), n, config)
    return models


@register("op11_adaptive_scan")
def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every 50th vector, by cosine."""
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
