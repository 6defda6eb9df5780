"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit for each position that is set in more than half of the document's
shingle hashes (XXH64, seed 42). Pairs are searched in two steps:

1. Buckets. For ``max_bits`` differing bits the 64 bits are cut into ``max_bits + 2`` blocks;
   two fingerprints that close agree in at least two blocks, so every pair of blocks gives
   one table of buckets and no close pair is missed. Where a pair is defined by shingle
   similarity instead (``near_copies``), buckets are bands of minimum hashes; the groups they
   make are only candidates, whose pairs are compared on their real shingles.
2. Pivots. Every fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints are
   tabulated. By the triangle inequality two close fingerprints differ by at most
   ``max_bits`` in every coordinate: rows of a bucket are sorted by the first coordinate and
   compared only while it fits, the rest is discarded by the largest coordinate difference,
   and only survivors are verified on their real bits.

Only distinct fingerprints (or texts) are compared, copies follow by their key. A bucket of
more than ``TILE_ROWS`` members is cut into tiles and tile pairs, so no task holds a whole
hot bucket. A task reports a spanning forest of the links it verified, not the pairs.

Defined results: null and empty texts have fingerprint 0 and link like any other; a text
with fewer words than a shingle is one shingle; equal texts share fingerprint and component;
null ids are ignored when the smallest id of a component is sought (null if it has none); an
empty table gives an empty result. Only named columns are read, others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield.llm.common import materialize, spread_join, text_of
from crossfield.llm.components import components
from crossfield.llm.registry import documents, register

SEED = 42
PIVOTS = 16
TILE_ROWS = 4096
BLOCK_ROWS = 65536
# Minimum hashes per text; twenty bands of four miss a similarity of 0.8 with probability 3e-5.
SKETCH, BANDS, BAND_ROWS = 128, 20, 4
# The share of equal minimum hashes has a standard error of 0.035 at 0.8. It only discards: a
# pair goes on to the exact comparison if its share is at most this much (four errors) below
# the wanted similarity.
SKETCH_SLACK = 0.14


def _mixed(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers (a multiplicative generator)."""
    out, state = [], salt
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(state ^ (state >> 29))
    return np.array(out, dtype=np.uint64)


PIVOT_TABLE = _mixed(PIVOTS, 7)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; A-Z are lower-cased."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:])], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority bits as an unsigned number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK_ROWS):
        octets = np.ascontiguousarray(hashes[at:at + BLOCK_ROWS]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` minimum hashes (32 bits each) of the set of shingles."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    factors, shifts = _mixed(SKETCH, 11) | np.uint64(1), _mixed(SKETCH, 13)
    for at in range(0, len(hashes), 1024):
        part = hashes[at:at + 1024, None] * factors + shifts
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, sketches: bool = False) -> DataFrame:
    """(doc_id, fingerprint as signed long), with ``sketches`` also the text's md5 and sketch."""
    source = df.select(F.col(doc_id).alias("doc_id"), text_of(text).cast("binary").alias("text"),
                       *([F.md5(text_of(text)).alias("node")] if sketches else []))
    fields = f"doc_id {df.schema[doc_id].dataType.simpleString()}, fingerprint long" + (", node string, sketch binary" if sketches else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, packed = [], []
            for value in batch.column("text"):
                hashes = shingle_hashes(value.as_py(), shingle)
                if sketches:  # likeness of sets: repeats do not count
                    hashes = np.unique(hashes)
                prints.append(fingerprint_of(hashes))
                if sketches:
                    packed.append(sketch_of(hashes).tobytes())
            columns = {"doc_id": batch.column("doc_id"), "fingerprint": pa.array(np.array(prints, np.uint64).view(np.int64))}
            if sketches:
                columns |= {"node": batch.column("node"), "sketch": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(run, fields)


def block_masks(max_bits: int) -> list[int]:
    """Masks of every pair of ``max_bits + 2`` blocks, as signed longs."""
    edges = np.linspace(0, 64, max_bits + 3).astype(int)
    blocks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [int(np.uint64(a | b).view(np.int64)) for a, b in combinations(blocks, 2)]


def _close_pairs(group: np.ndarray, tile: np.ndarray, prints: np.ndarray, max_bits: int,
                 sketches: np.ndarray | None, min_similarity: float, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows not joined yet, by distance along rows sorted by (group, first pivot distance)."""
    table = np.bitwise_count(prints[:, None] ^ PIVOT_TABLE).astype(np.int16)
    left, shift = np.arange(len(prints) - 1), 1
    while True:
        left = left[left + shift < len(prints)]
        right = left + shift
        fits = (group[left] == group[right]) & (table[right, 0] - table[left, 0] <= max_bits)
        left, right = left[fits], right[fits]
        if not len(left):
            return
        a, b = left, right
        across = ((tile[a] < 0) | (tile[a] != tile[b])) & (root[a] != root[b])
        a, b = a[across], b[across]
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= max_bits
        a, b = a[near], b[near]
        true = np.bitwise_count(prints[a] ^ prints[b]) <= max_bits
        a, b = a[true], b[true]
        if sketches is not None and len(a):
            alike = (sketches[a] == sketches[b]).mean(axis=1) >= min_similarity
            a, b = a[alike], b[alike]
        yield a, b
        shift += 1


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _flatten(root: np.ndarray) -> None:
    while True:
        up = root[root]
        if (up == root).all():
            return
        root[:] = up


def _join(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
    """Lead each row in ``root`` to the smallest row it is joined to by the pairs."""
    for a, b in pairs:
        new = root[a] != root[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            x, y = _find(root, x), _find(root, y)
            if x != y:
                root[max(x, y)] = min(x, y)
        _flatten(root)


def _alike_pairs(group: np.ndarray, tile: np.ndarray, sketches: np.ndarray, texts: pa.Array, shingle: int, similarity: float,
                 root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows not joined yet whose sets of shingle hashes reach the similarity."""
    sets: dict[int, np.ndarray] = {}

    def of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = np.unique(shingle_hashes(texts[x].as_py(), shingle))
        return sets[x]

    def alike(x: int, y: int) -> bool:
        a, b = of(x), of(y)
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(len(a) + len(b) - both, 1) >= similarity or not len(a)

    left, shift = np.arange(len(root) - 1), 1
    while True:
        left = left[left + shift < len(root)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            return
        a, b = left, left + shift
        ahead = ((tile[a] < 0) | (tile[a] != tile[b])) & (root[a] != root[b])
        a, b = a[ahead], b[ahead]
        near = (sketches[a] == sketches[b]).mean(axis=1) >= similarity - SKETCH_SLACK if len(a) else np.zeros(0, bool)
        for x, y in zip(a[near], b[near]):
            if _find(root, x) != _find(root, y) and alike(int(x), int(y)):
                yield np.array([x]), np.array([y])
        shift += 1


def link_buckets(members: DataFrame, max_bits: int, facts: DataFrame | None = None, min_similarity: float = 0.0,
                 tile_rows: int = TILE_ROWS, shingle: int = 0) -> DataFrame:
    """Links (a, b) that span the close members of each bucket.

    ``members`` has (table, key, node, fingerprint), one row per distinct member; ``facts``
    (node, sketch) adds the sketch to compare. With ``shingle``, facts also has the text, and
    members are close if their sets of shingles reach ``min_similarity``, whatever their bits.
    """
    node_type = members.schema["node"].dataType.simpleString()
    sizes = members.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes.select(F.col("table").alias("s_table"), F.col("key").alias("s_key"),
                                     F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles")), "bucket-sizes")
    crowded = members.join(sizes, (F.col("table") == F.col("s_table")) & (F.col("key") == F.col("s_key"))).drop("s_table", "s_key")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiled = crowded.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = tiled.select(
        "node", "fingerprint", F.xxhash64("table", "key").alias("bucket"), "table", "key", "own",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(int(PIVOT_TABLE[0].view(np.int64))))).alias("d0"))
    if facts is not None:
        rows = rows.join(facts.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node")).drop("f_node")
    order = ["table", "key", "lo", "hi"]
    rows = rows.repartition(*order).sortWithinPartitions(*order, "d0", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            chunk = pa.Table.from_batches([batch])
            held = chunk if held is None else pa.concat_tables([held, chunk])
            ids = _groups(held, order)
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if cut > (2_000 if shingle else 20_000):
                yield _linked(held.slice(0, cut), ids[:cut], max_bits, min_similarity, shingle)
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield _linked(held, _groups(held, order), max_bits, min_similarity, shingle)

    return rows.mapInArrow(run, f"a {node_type}, b {node_type}")


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Running number of the group each row of a sorted table belongs to."""
    new = np.zeros(table.num_rows, bool)
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _linked(table: pa.Table, group: np.ndarray, max_bits: int, min_similarity: float, shingle: int) -> pa.RecordBatch:
    prints = table.column("fingerprint").to_numpy().view(np.uint64)
    lo, hi, own = (table.column(c).to_numpy() for c in ("lo", "hi", "own"))
    tile = np.where(lo == hi, -1, own)
    sketches = None
    if "sketch" in table.column_names:
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH)
    root = np.arange(len(prints))
    if shingle:
        _join(root, _alike_pairs(group, tile, sketches, table.column("text"), shingle, min_similarity, root))
    else:
        _join(root, _close_pairs(group, tile, prints, max_bits, sketches, min_similarity, root))
    moved = np.flatnonzero(root != np.arange(len(root)))
    nodes = table.column("node").combine_chunks()
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], names=["a", "b"])


def cluster(prints: DataFrame, max_bits: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of (doc_id, fingerprint) rows; links at ``max_bits`` or fewer bits."""
    prints = materialize(prints, "fingerprints")
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    masks = block_masks(max_bits)
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    members = nodes.select(F.col("fingerprint").alias("node"), "fingerprint", F.explode(keys).alias("k")).select("k.*", "node", "fingerprint")
    roots = components(link_buckets(members, max_bits, tile_rows=tile_rows))
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", "n", F.coalesce("root", "fingerprint").alias("root"))
    rooted = materialize(rooted, "rooted")
    n_nodes, n_rows = _sizes(rooted)
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    table = spread_join(rooted, named, "root", "r", "nodes", n_nodes).select(F.col("fingerprint").alias("f"), "component_id", "n")
    return spread_join(prints, materialize(table, "table"), "fingerprint", "f", "n", n_rows).select("doc_id", "fingerprint", "component_id")


def _sizes(nodes: DataFrame) -> tuple[int, int]:
    """Nodes, and rows that have them (column ``n``)."""
    row = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8,
                max_bits: int = 28, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, node, component_id, stays, repeats): near copies by shingle similarity.

    Texts are candidates if a band of their minimum hashes agrees; the pivot tables, the SimHash
    distance over distinct shingles (``max_bits`` lies six deviations above the distance expected
    at 0.8) and the share of equal minimum hashes discard only what is far away. Candidates that
    hang together are a loose group; within it every pair that would join two components is
    decided by the Jaccard similarity of the texts' distinct shingle hashes. ``stays`` marks the
    rows of the smallest id of a component (of the smallest node, if no id is known);
    ``repeats`` is how many rows agree in id and text.
    """
    prints = materialize(fingerprints(df, text, doc_id, shingle, sketches=True), "prints")
    nodes = prints.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first"),
                                         F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes, "nodes")
    width = 4 * BAND_ROWS
    bands = F.array(*[F.struct(F.lit(i).alias("table"), F.xxhash64(F.substring("sketch", i * width + 1, width)).alias("key")) for i in range(BANDS)])
    members = nodes.select("node", "fingerprint", F.explode(bands).alias("k")).select("k.*", "node", "fingerprint")
    sketches = nodes.select("node", "sketch")
    loose = materialize(components(link_buckets(members, max_bits, sketches, similarity - SKETCH_SLACK, tile_rows)), "loose")
    grouped = loose.select(F.lit(0).alias("table"), F.col("root").alias("key"), "node", F.lit(0).cast("long").alias("fingerprint"))
    wanted = nodes.join(loose.select(F.col("node").alias("l_node")), F.col("node") == F.col("l_node")).select(
        F.col("node").alias("w_node"), F.col("first").alias("w_first"), "sketch")
    rows = df.select(F.col(doc_id).alias("id"), F.md5(text_of(text)).alias("node"), text_of(text).cast("binary").alias("text"))
    facts = rows.join(wanted.hint("merge"), (F.col("node") == F.col("w_node")) & F.col("id").eqNullSafe(F.col("w_first"))).select(
        "node", "sketch", "text").dropDuplicates(["node"])
    links = link_buckets(grouped, 64, materialize(facts, "facts"), similarity, tile_rows, shingle)
    rooted = nodes.select("node", "first", "n").join(components(links).withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select(
        "node", "first", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    n_nodes, n_rows = _sizes(rooted)
    order = F.struct(F.col("first").isNull(), "first", "node")
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("nodes")).select(
        "r", F.col("m.first").alias("component_id"), F.col("m.node").alias("keeper"), "nodes")
    chosen = spread_join(rooted, named, "root", "r", "nodes", n_nodes).select(F.col("node").alias("c_node"), "component_id", "keeper", "n")
    rows = prints.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("repeats"))
    rows = spread_join(rows, materialize(chosen, "chosen"), "node", "c_node", "n", n_rows)
    stays = (F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.select("doc_id", "node", "component_id", stays.alias("stays"), "repeats")


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near copies, all columns as they came."""
    stays = near_copies(df, text, doc_id, **options).filter("stays").select(
        F.col("doc_id").alias("s_id"), F.col("node").alias("s_node"), F.col("repeats").alias("s_repeats"))
    packed = df.select(F.struct("*").alias("d"), F.col(doc_id).alias("id"), F.md5(text_of(text)).alias("node"))
    kept = packed.join(stays, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("node") == F.col("s_node")))
    once = kept.filter("s_repeats = 1").select("d")
    again = kept.filter("s_repeats > 1").groupBy("s_id", "s_node").agg(F.first("d").alias("d")).select("d")
    return once.union(again).select("d.*")


@register("op3_simhash")
def op3_simhash(spark, sf_dir):
    found = cluster(fingerprints(documents(spark, sf_dir)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs, sf_dir):
    """Pipeline stage: one document of each group of near copies stays (five words, similarity 0.8)."""
    return dedup(docs)
