"""Exact integer k-means, each vector finding its centroid in a vantage-point tree.

Components become floor(SCALE * x). A round builds a vantage-point tree over the centroids on
the driver (there are ``clusters`` of them, whatever the table's size), sends it to the tasks
and reads the table once:

* every inner node holds one centroid (its vantage point) and, for each of its two subtrees,
  the nearest and farthest distance from it; a leaf holds a few centroids;
* each vector visits nodes best first, by the least distance that the triangle inequality
  leaves them. A node is left out only if that bound exceeds the best distance so far: the
  radius is inclusive, so a centroid at an equal distance with a smaller number is still met.
  Bounds are lowered by more than their rounding error, and distances that decide are exact
  integers. The vectors of a batch walk together: a step takes every vector's own next node;
* a task returns one row per cluster it met (count and component sums), so a hot cluster moves
  as many rows as any other. Sums are added as decimals and divided exactly, rounding down.

Nothing but seeds, centroids and sums per cluster reaches the driver, and the table is never
shuffled. A lost task is run again from the input.

Defined results: vectors that are null, of another length, or hold null or non-finite
components take no part, nor do vectors longer than 2**29 after scaling (their squared
distances would not fit a long). Repeated rows count as often as they stand; a null id takes
part but is no seed. Fewer vectors than clusters give fewer clusters, no vectors an empty
result. Only the named columns are read, others never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfield.llm.common import materialize
from crossfield.llm.registry import register
from crossfield.llm.vectors import finite, integers, matrix, squared_length

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
SEED = 1
# Most centroids in a leaf.
LEAF = 2
# Squared lengths from here on are left out.
TOO_LONG = 2.0**58
# Share of a distance by which bounds are lowered: far above the rounding of a double.
SLACK = 1e-9


@dataclass(frozen=True)
class Node:
    """Centroids to measure, and subtrees as (node, nearest, farthest distance from the vantage point)."""

    centroids: tuple[int, ...]
    below: tuple[tuple[int, float, float], ...] = ()


@dataclass(frozen=True)
class Tree:
    nodes: tuple[Node, ...]
    centroids: np.ndarray


def squared_distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def build(centroids: np.ndarray) -> Tree:
    """A vantage-point tree; of a node's centroids, the one farthest from their mean is its vantage point."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        here = len(nodes)
        nodes.append(Node(tuple(members)))
        if len(members) <= LEAF:
            return here
        mean = centroids[members].mean(axis=0)
        vantage = max(members, key=lambda i: (((centroids[i] - mean) ** 2).sum(), -i))
        rest = [i for i in members if i != vantage]
        away = dict(zip(rest, np.sqrt(squared_distances(centroids[rest], centroids[vantage]).astype(float)), strict=True))
        rest.sort(key=lambda i: (away[i], i))
        half = (len(rest) + 1) // 2
        below = [(grow(part), away[part[0]], away[part[-1]]) for part in (rest[:half], rest[half:]) if part]
        nodes[here] = Node((vantage,), tuple(below))
        return here

    grow(list(range(len(centroids))))
    return Tree(tuple(nodes), centroids)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (ties: the smaller number) and the squared distance."""
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    who = np.full(len(vectors), len(tree.centroids))
    bound = np.full((len(vectors), len(tree.nodes)), np.inf)
    bound[:, 0] = 0.0
    open_rows = np.arange(len(vectors))
    while len(open_rows):
        node = bound[open_rows].argmin(axis=1)
        least = bound[open_rows, node]
        visit = least <= np.sqrt(best[open_rows].astype(float))
        open_rows, node, least = open_rows[visit], node[visit], least[visit]
        for number in np.unique(node):
            at = node == number
            rows, low, entry = open_rows[at], least[at], tree.nodes[number]
            bound[rows, number] = np.inf
            for centroid in entry.centroids:
                squared = squared_distances(vectors[rows], tree.centroids[centroid])
                closer = (squared < best[rows]) | ((squared == best[rows]) & (centroid < who[rows]))
                best[rows[closer]], who[rows[closer]] = squared[closer], centroid
            for child, near, far in entry.below:
                away = np.sqrt(squared.astype(float))
                reach = np.maximum(away - far, near - away) - SLACK * (away + far + 1)
                bound[rows, child] = np.maximum(reach, low)
    return who, best


def kept(df: DataFrame, key: str, vector: str, scale: int, dimensions: int) -> DataFrame:
    """(key, components) of the vectors that take part."""
    column = F.col(vector)
    usable = finite(column) & (F.size(column) == dimensions) & (squared_length(column, scale) < TOO_LONG)
    return df.filter(usable).select(F.col(key).alias("key"), integers(column, scale).alias("components"))


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            vectors = matrix(batch.column("components")).astype(np.int64)
            yield batch.column("key"), vectors, *nearest(tree, vectors)


def new_centroids(rows: DataFrame, tree: Tree) -> np.ndarray:
    """Every non-empty cluster's exact floor of the mean; empty ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(tree.centroids), np.int64)
        total = np.zeros(tree.centroids.shape, np.int64)
        for _, vectors, who, _ in _assigned(batches, tree):
            count += np.bincount(who, minlength=len(count))
            order = np.argsort(who, kind="stable")
            met, first = np.unique(who[order], return_index=True)
            total[met] += np.add.reduceat(vectors[order], first, axis=0)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(met, pa.int32()), "n": pa.array(count[met], pa.int64()),
            "sums": pa.array(total[met].tolist(), pa.list_(pa.int64()))})

    partial = rows.mapInArrow(sums, "cluster int, n long, sums array<long>")
    added = partial.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = tree.centroids.copy()
    for row in added.toLocalIterator():  # clusters x components, whatever the table's size
        out[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return out


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = kept(df, key, vector, scale, dimensions)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    seeds = rows.select(rank.alias("rank"), "components").filter("rank IS NOT NULL").orderBy("rank", "components").limit(clusters).collect()
    centroids = np.array([s["components"] for s in seeds], np.int64).reshape(len(seeds), dimensions)
    if not seeds:
        rows = rows.filter(F.lit(False))
    for _ in range(rounds if seeds else 0):
        centroids = new_centroids(rows, build(centroids))
    tree = build(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, who, best in _assigned(batches, tree):
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(who, pa.int32()), pa.array(best, pa.int64())], ["key", "cluster", "distance"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(place, f"key {kind}, cluster int, distance long").withColumnRenamed("key", key), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the distance summed over the cluster and over all, and the digest of the centroid."""
    assigned = materialize(assigned, "clusters")
    per_cluster = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [(c, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, total in sorted(per_cluster.items())]
    table = assigned.sparkSession.createDataFrame(
        facts, "number int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), F.col("cluster") == F.col("number")).withColumn(
        "inertia", F.lit(sum(per_cluster.values())).cast("long")).drop("number")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS) -> str:
    """The same rounds as DuckDB SQL; integers below 2**53 are exact as doubles."""

    def assign(k: int) -> str:
        return f"""
        near{k} AS MATERIALIZED (
            SELECT v.row, v.vec_id, v.c, arg_min(k.number, (k.d, k.number)) AS cluster, min(k.d) AS distance
            FROM v, LATERAL (SELECT number, (list_dot_product(v.c, v.c) - 2 * list_dot_product(v.c, cen{k}.c)
                + list_dot_product(cen{k}.c, cen{k}.c))::BIGINT AS d FROM cen{k}) k
            GROUP BY v.row, v.vec_id, v.c)"""

    def move(k: int) -> str:
        return f"""
        cen{k + 1} AS MATERIALIZED (
            SELECT cen{k}.number, coalesce(m.c, cen{k}.c) AS c
            FROM cen{k} LEFT JOIN (
                SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS c FROM (
                    SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (
                        SELECT cluster, unnest(c)::BIGINT AS x, generate_subscripts(c, 1) AS pos FROM near{k})
                    GROUP BY cluster, pos)
                GROUP BY cluster) m ON m.cluster = cen{k}.number)"""

    steps = ",".join(assign(k) + "," + move(k) for k in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id,
            list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS c
        FROM embeddings
        WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimensions}
            AND list_sum(list_transform(embedding, lambda x: pow({scale} * x::DOUBLE, 2))) < pow(2, 58)),
    cen0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h, c) - 1 AS number, c
        FROM (SELECT sha256('{SEED}:' || vec_id) AS h, c FROM v WHERE vec_id IS NOT NULL ORDER BY h, c LIMIT {clusters})),
    {steps}, {assign(rounds)}
    SELECT n.vec_id, n.cluster::INTEGER AS cluster, n.distance,
        (sum(n.distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia,
        (sum(n.distance) OVER ())::BIGINT AS inertia,
        sha256(list_aggregate(list_transform(k.c, lambda x: x::BIGINT), 'string_agg', ',')) AS centroid_sha256
    FROM near{rounds} n JOIN cen{rounds} k ON k.number = n.cluster"""


ORACLE = _sql()


@register("op12_vantage_point_clusters", ORACLE)
def op12_vantage_point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster after three rounds of integer k-means."""
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(assigned, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
