"""Hard negatives from exact integer scores, multiplied in a residue number system.

Components become floor(SCALE * x); a score is an exact integer inner product.

* Residues. A pair of blocks is multiplied modulo several primes in float32: symmetric residues
  are at most 510 in size, and at most ``depth`` columns are summed before the next reduction,
  so every partial sum is below 2**24 and exact in float32. The primes' product exceeds four times
  the largest possible score of the two blocks (the product of their longest rows), so Chinese
  remaindering in mixed radix gives the exact signed score.
* Positives. Rows are dealt to blocks within their label, anchors to chunks within theirs; a
  label's blocks and chunks meet in a grid of tasks, so a label that holds all rows is spread
  like any other. A task keeps the first ``positives`` of each anchor.
* Negatives. The second grid deals all rows to blocks and all anchors (with their positives) to
  chunks. For each positive a task keeps the first ``negatives`` rows of other labels whose score
  lies in its window; a window over the ranks of all tasks makes the final choice.

A task holds one block and one chunk, and scores a slice of the chunk at a time. Rows move once
for each chunk, anchors once for each block: that is 1 / ``CHUNK_ROWS`` of the products.

Defined results: rows with a null label, a null or empty vector, or null or non-finite components
take no part, nor rows without an id (they cannot be named) and rows longer than 2**30 after
scaling (scores would not fit a long). Of rows that share an id the one with the smallest vector, then label,
counts. Only vectors of equal length are compared. Equal scores go by the smaller id. An
empty table gives an empty result. Only the named columns are read, others never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield.llm.common import materialize
from crossfield.llm.registry import register
from crossfield.llm.vectors import finite, first_of_each, integers, matrix, one_row_per_id, squared_length
from crossfield.plans.scale import attach

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score is at least LEAST and at most MOST hundredths of the positive's.
LEAST, MOST = 50, 95
# Rows of a block and of a chunk of anchors, and anchors scored at once.
BLOCK_ROWS, CHUNK_ROWS, SLICE_ROWS = 4096, 2048, 256
# A grid is at least this many blocks wide if they keep at least so many rows.
SPREAD, SMALL_BLOCK = 64, 512
# Squared lengths from here on are left out.
TOO_LONG = 2.0**60
# Sums in float32 are exact below this.
EXACT = 2**24
LARGEST_PRIME = 1021


@cache
def primes(product: int) -> tuple[int, ...]:
    """The largest primes up to LARGEST_PRIME whose product exceeds ``product``."""
    found: list[int] = []
    n = LARGEST_PRIME
    while math.prod(found) <= product:
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            found.append(n)
        n -= 1
    return tuple(found)


def _signed(n: int) -> np.int64:
    """An integer modulo 2**64, as numpy's wrapping arithmetic holds it."""
    return np.int64((n + 2**63) % 2**64 - 2**63)


def residues(rows: np.ndarray, prime: int) -> np.ndarray:
    """Symmetric residues as float32."""
    half = prime // 2
    return ((rows + half) % prime - half).astype(np.float32)


def product_modulo(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """left @ right.T modulo a prime, from residues in float32."""
    depth = EXACT // (prime // 2) ** 2
    total = np.zeros((len(left), len(right)), np.int32)
    for start in range(0, left.shape[1], depth):
        total += (left[:, start:start + depth] @ right[:, start:start + depth].T).astype(np.int32) % prime
        total %= prime
    return total


def reconstruct(remainders: list[np.ndarray], moduli: tuple[int, ...]) -> np.ndarray:
    """Signed integers from their remainders: mixed-radix digits, the last of which tells the sign."""
    digits: list[np.ndarray] = []
    for k, (remainder, prime) in enumerate(zip(remainders, moduli, strict=True)):
        rest, weight = remainder.astype(np.int64), 1
        for digit, earlier in zip(digits, moduli[:k], strict=True):
            rest = rest - digit * (weight % prime)
            weight *= earlier
        digits.append(rest % prime * pow(weight, -1, prime) % prime if k else rest % prime)
    value, weight = np.zeros_like(digits[0]), 1
    for digit, prime in zip(digits, moduli, strict=True):
        value, weight = value + digit * _signed(weight), weight * prime
    return np.where(digits[-1] > moduli[-1] // 2, value - _signed(weight), value)


def scores(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Exact inner products of all rows, a slice of ``left`` at a time: (first row, scores)."""
    def longest(rows: np.ndarray) -> int:
        return math.isqrt(int(np.einsum("ij,ij->i", rows, rows).max())) + 1

    moduli = primes(4 * longest(left) * longest(right))
    sides = [(residues(left, p), residues(right, p)) for p in moduli]
    for start in range(0, len(left), SLICE_ROWS):
        part = [product_modulo(a[start:start + SLICE_ROWS], b, p) for (a, b), p in zip(sides, moduli, strict=True)]
        yield start, reconstruct(part, moduli)


def best_positives(anchors: pa.Table, rows: pa.Table, most: int) -> Iterator[pa.Table]:
    """Of one label: the first ``most`` other rows of each anchor in a block, by score and id."""
    rows = rows.sort_by("id")
    ids, asked = rows["id"].to_numpy(), anchors["id"].to_numpy()
    for start, found in scores(matrix(anchors["components"]).astype(np.int64), matrix(rows["components"]).astype(np.int64)):
        slice_ids = asked[start:start + len(found)]
        if len(ids) > 2 * most:  # everything at or above the place that the limit can reach, own row included
            cut = np.partition(found, len(ids) - most - 1, axis=1)[:, len(ids) - most - 1]
            at, other = np.nonzero(found >= cut[:, None])
        else:
            at, other = (x.ravel() for x in np.indices(found.shape))
        others = ids[other] != slice_ids[at]
        at, other = at[others], other[others]
        value = found[at, other]
        order = np.lexsort((other, -value, at))
        order = order[first_of_each(at[order], most)]
        yield pa.table({"anchor_id": slice_ids[at[order]], "positive_id": ids[other[order]], "positive_score": value[order]})


def best_negatives(anchors: pa.Table, rows: pa.Table, most: int, least_share: int, most_share: int) -> Iterator[pa.Table]:
    """The first ``most`` rows of other labels in each positive's window of scores."""
    rows = rows.sort_by("id")
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    asked, asked_labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
    given = anchors["positives"].to_pylist()
    # 128-bit safe: shares are taken on Python integers, once for each positive.
    low = [[-(-least_share * p["positive_score"] // 100) for p in ps] for ps in given]
    high = [[most_share * p["positive_score"] // 100 for p in ps] for ps in given]
    floor = np.array([min(x, default=0) for x in low], np.int64)
    ceiling = np.array([max(x, default=-1) for x in high], np.int64)
    for start, found in scores(matrix(anchors["components"]).astype(np.int64), matrix(rows["components"]).astype(np.int64)):
        stop = start + len(found)
        fits = (found >= floor[start:stop, None]) & (found <= ceiling[start:stop, None])
        fits &= labels[None, :] != asked_labels[start:stop, None]
        at, other = np.nonzero(fits)
        value = found[at, other]
        order = np.lexsort((other, -value, at))
        at, other, value = at[order], other[order], value[order]
        for j in range(max((len(ps) for ps in given[start:stop]), default=0)):
            has = np.array([len(ps) > j for ps in given[start:stop]])
            lo = np.array([x[j] if len(x) > j else 0 for x in low[start:stop]], np.int64)
            hi = np.array([x[j] if len(x) > j else -1 for x in high[start:stop]], np.int64)
            inside = np.flatnonzero(has[at] & (value >= lo[at]) & (value <= hi[at]))
            chosen = inside[first_of_each(at[inside], most)]
            positive = [given[start + a][j] for a in at[chosen].tolist()]
            yield pa.table({
                "anchor_id": asked[start:stop][at[chosen]],
                "positive_id": pa.array([p["positive_id"] for p in positive], pa.int64()),
                "positive_score": pa.array([p["positive_score"] for p in positive], pa.int64()),
                "negative_id": ids[other[chosen]], "negative_score": value[chosen]})


def _grid_size(rows: Column, anchors: Column) -> tuple[Column, Column]:
    wide = F.least(F.lit(SPREAD), F.ceil(rows / F.lit(SMALL_BLOCK)))
    return F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS)), wide).cast("int"), F.ceil(anchors / F.lit(CHUNK_ROWS)).cast("int")


def _meet(rows: DataFrame, anchors: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Deal rows to blocks and anchors to chunks of each key, and run ``work`` on every pair of them."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(
        anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
    blocks, chunks = _grid_size(F.col("n"), F.col("m"))
    sizes = materialize(sizes.select(*keys, blocks.alias("blocks"), chunks.alias("chunks")), "grid")

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        table = table.select(*[F.col(c).alias(c) for c in table.columns])  # both sides may come from one table
        place = F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")
        return attach(table, sizes, keys, "inner").withColumns({
            own: place, other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))}).drop("blocks", "chunks")

    by = [*keys, "block", "chunk"]
    left, right = dealt(rows, "block", "chunk"), dealt(anchors, "chunk", "block")

    def pair(block: pa.Table, chunk: pa.Table) -> pa.Table:
        none = pa.schema([(n, pa.int64()) for n in names])
        if not len(block) or not len(chunk):
            return none.empty_table()
        return pa.concat_tables([none.empty_table(), *(t.cast(none) for t in work(chunk, block))])

    names = [part.split()[0] for part in schema.split(", ")]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(pair, schema)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST, most_share: int = MOST,
) -> DataFrame:
    """For each anchor (a condition on ``id``) and each of its positives, the hardest negatives in the window.

    ``label`` is a long; a null label leaves the row out.
    """
    column = F.col(vector)
    usable = finite(column) & label.isNotNull() & (squared_length(column, scale) < TOO_LONG)
    rows = df.filter(usable).select(F.col(key).cast("long").alias("id"), integers(column, scale).alias("components"), label.alias("label"))
    rows = materialize(one_row_per_id(rows, "id", "components", "label").withColumn("length", F.size("components")), "integers")
    anchors = rows.filter(is_anchor)
    pairs = _meet(rows, anchors, ["length", "label"], lambda chunk, block: best_positives(chunk, block, positives),
                  "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = pairs.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    # At most ``positives`` pairs of an anchor.
    given = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = materialize(anchors.join(given, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "anchors")
    triples = _meet(rows, asked, ["length"], lambda chunk, block: best_negatives(chunk, block, negatives, least_share, most_share),
                    "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return triples.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)


ORACLE = """
    WITH v AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
            AND list_sum(list_transform(embedding, lambda x: pow(256 * x::DOUBLE, 2))) < pow(2, 60)),
    one AS MATERIALIZED (
        SELECT id, m.label AS label, m.c AS c
        FROM (SELECT id, min({'c': c, 'label': label}) AS m FROM v GROUP BY id)),
    s AS MATERIALIZED (
        SELECT a.id AS anchor, a.label AS mine, b.id AS other, b.label AS theirs, list_dot_product(a.c, b.c)::BIGINT AS score
        FROM one a JOIN one b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.c) = len(b.c)),
    p AS (
        SELECT anchor, other, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS place
        FROM s WHERE mine = theirs),
    n AS (
        SELECT p.anchor, p.other AS positive, p.score AS positive_score, s.other AS negative, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS place
        FROM p JOIN s ON p.place <= 5 AND s.anchor = p.anchor AND s.mine <> s.theirs
            AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor AS anchor_id, positive AS positive_id, place::INTEGER AS rank, negative AS negative_id,
        positive_score, negative_score
    FROM n WHERE place <= 3"""


@register("op13_hard_negatives", ORACLE)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, labels of every 7th shifted by one."""
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    found = mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, shifted)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
