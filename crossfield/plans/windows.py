"""Medians and median absolute deviations of long sliding windows, whatever a group's size.

Rows of a group are numbered along an order; the window of a row is a stretch [s, e) of these
numbers that never moves back. A window may hold a fifth of a group of any size, so no task
sees one. Instead:

1. *Tiles.* Queries are cut where row + s + e passes a multiple of the tile size, so a tile's
   own rows and the rows that enter or leave its windows are together one tile size at most.
2. *Summaries.* Rows are ranked by value too and cut into buckets of one tile size. For every
   quarter tile of the order, the rows up to it are counted per bucket; the difference of two
   of these counts tells how many rows of each bucket lie in the *core* that all windows of a
   tile share, up to its two edges.
3. *Medians.* The windows of a tile differ from the core by its edge rows only, so their
   medians lie in a few neighbouring buckets: a tile reads these rows of the core and its edge
   rows; whole buckets below are only counted.
4. *Deviations.* The k nearest values of a median are neighbours in sorted order. The counts give
   two zones of buckets, below and above, that hold the ends of that stretch for all medians of
   a tile; a tile reads their rows and searches the ends by rank. Where medians jump (values
   in two clumps), the queries are cut into runs of near medians, each with its own zones.

Ranks in a window are found in a wavelet matrix over the edge rows, together with the counts of
the core rows read, for all queries of a tile at once. A task holds the edges (at most one
and a half tile sizes) and a few buckets. A group is cut into at most ``MOST_TILES`` tiles, so its
summary stays below 4 * MOST_TILES**2 counts; larger groups get larger tiles.

Where no window is longer than a tile, none of this is needed: a tile's task reads all rows of its
windows, at most four tile sizes.

Results are exact: they are the numbers that sorting each window would give.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossfield.plans.ordering import with_tiles
from crossfield.plans.scale import attach, grid_join, stored

MOST_TILES = 4096
# Edge rows of a block of windows that one task solves at once.
BLOCK_ROWS = 8192
# Core rows, in tile sizes, above which a tile's medians are cut into runs.
RUN_TILES = 8
# Relative widening of the zones, far above the rounding of a double.
SLACK = 1e-9


class RankedStretch:
    """Order statistics of any stretch of a sequence of symbols plus a fixed multiset of them."""

    def __init__(self, sequence: np.ndarray, fixed: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols).bit_length())
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(fixed, minlength=1 << self.bits))])
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def select(self, first: np.ndarray, last: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The symbol at place k (from 0) of sequence[first:last] and the fixed ones together."""
        symbol = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[first], zeros[last]
            left = b - a + self.counts[symbol + (1 << bit)] - self.counts[symbol]
            up = k >= left
            k = np.where(up, k - left, k)
            first = np.where(up, zeros[-1] + first - a, a)
            last = np.where(up, zeros[-1] + last - b, b)
            symbol = symbol + (up.astype(np.int64) << bit)
        return symbol

    def below(self, first: np.ndarray, last: np.ndarray, symbol: int) -> np.ndarray:
        """How many of sequence[first:last] are smaller than a symbol."""
        total = np.zeros(len(first), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[first], zeros[last]
            if symbol >> bit & 1:
                total += b - a
                first, last = zeros[-1] + first - a, zeros[-1] + last - b
            else:
                first, last = a, b
        return total


class Tile:
    """The queries, edge rows, core rows read and bucket counts of one tile."""

    def __init__(self, rows: pa.Table, facts: dict):
        kind = rows["kind"].to_numpy()

        def of(name: str, which: int) -> np.ndarray:
            return rows[name].to_numpy(zero_copy_only=False)[kind == which]

        self.size, self.lo, self.hi = facts["size"], np.array(facts["lo"]), np.array(facts["hi"])
        self.before = np.concatenate([[0], np.cumsum(facts["base"])]).astype(np.int64)  # core rows in earlier buckets
        order = np.argsort(of("rank", 0))
        self.rank, self.s, self.e = (of(c, 0)[order].astype(np.int64) for c in ("rank", "s", "e"))
        self.n = self.e - self.s
        edge = np.argsort(of("rank", 1))
        edge_rank, edge_value_rank = (of(c, 1)[edge].astype(np.int64) for c in ("rank", "vrank"))
        self.edge_values = np.sort(of("v", 1))
        self.first, self.last = np.searchsorted(edge_rank, self.s), np.searchsorted(edge_rank, self.e)
        core = of("vrank", 2).astype(np.int64)
        ranks = np.concatenate([edge_value_rank, core])
        values = np.concatenate([of("v", 1)[edge], of("v", 2)])
        order = np.argsort(ranks)
        self.ranks, self.values = ranks[order], values[order]
        place = np.empty(len(ranks), np.int64)
        place[order] = np.arange(len(ranks))
        self.stretch = RankedStretch(place[:len(edge)], place[len(edge):], len(ranks))

    def value(self, k: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of the rows at hand in each window: the value at place k."""
        return self.values[self.stretch.select(self.first[at], self.last[at], k)]

    def start(self, bucket: int) -> np.ndarray:
        """Where a bucket begins in each window, sorted."""
        symbol = int(np.searchsorted(self.ranks, bucket * self.size))
        return self.before[bucket] + self.stretch.below(self.first, self.last, symbol)

    def medians(self, lowest: int) -> np.ndarray:
        """Medians, the core rows from bucket ``lowest`` on being at hand as far as they are needed."""
        skipped = self.before[lowest]
        return (self.value((self.n - 1) // 2 - skipped) + self.value(self.n // 2 - skipped)) / 2.0

    def zones(self, least: float, most: float, n_least: int, n_most: int) -> tuple[int, int, int, int]:
        """Bucket ranges [l0, l1) and [u0, u1) that hold the ends of the nearest halves of all medians in [least, most]."""
        lo, hi, before, edge = self.lo, self.hi, self.before, self.edge_values
        d = np.unique(np.abs(np.concatenate([lo - least, hi - least, lo - most, hi - most])))
        touched = np.maximum(before[np.searchsorted(lo, most + d, "right")] - before[np.searchsorted(hi, least - d)], 0)
        touched += np.searchsorted(edge, most + d, "right") - np.searchsorted(edge, least - d)
        inside = before[np.searchsorted(hi, least + d, "right")] - before[np.searchsorted(lo, most - d)]
        short, enough = touched < max(n_least // 2, 1), inside >= n_most // 2 + 1
        near = d[short].max(initial=0.0)
        far = d[enough].min(initial=np.inf)
        slack = SLACK * (abs(least) + abs(most) + (far if np.isfinite(far) else 0.0))
        near, far = max(near - slack, 0.0), far + slack
        l0, l1 = np.searchsorted(hi, least - far), np.searchsorted(lo, most - near, "right")
        u0, u1 = np.searchsorted(hi, least + near), np.searchsorted(lo, most + far, "right")
        if u0 <= l1:
            return int(l0), int(max(l1, u1)), int(max(l1, u1)), int(max(l1, u1))
        return int(l0), int(max(l0, l1)), int(u0), int(max(u0, u1))

    def runs(self, medians: np.ndarray) -> list[tuple[np.ndarray, tuple[int, int, int, int]]]:
        """Queries in runs of near medians, each with zones of a bounded number of core rows."""
        order, out = np.argsort(medians, kind="stable"), []
        stack = [(0, len(order))]
        while stack:
            a, b = stack.pop()
            part = order[a:b]
            zone = self.zones(medians[part[0]], medians[part[-1]], int(self.n[part].min()), int(self.n[part].max()))
            rows = self.before[zone[1]] - self.before[zone[0]] + self.before[zone[3]] - self.before[zone[2]]
            if rows > RUN_TILES * self.size and medians[part[0]] < medians[part[-1]]:
                stack += [(a, (a + b) // 2), ((a + b) // 2, b)]
            else:
                out.append((part, zone))
        return out

    def deviations(self, centre: np.ndarray, zone: tuple[int, int, int, int]) -> np.ndarray:
        """The median absolute deviation of each window, the core rows of both zones being at hand."""
        l0, l1, u0, u1 = zone
        bounds = [self.start(b) for b in (l0, l1, u0, u1)]
        skipped, gap = self.before[l0], self.before[u0] - self.before[l1]

        def known(place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Values at places of the sorted window, and which of them are at hand."""
            lower = (place >= bounds[0][at]) & (place < bounds[1][at])
            upper = (place >= bounds[2][at]) & (place < bounds[3][at])
            k = np.where(upper & ~lower, place - skipped - gap, place - skipped)
            hit = lower | upper
            return self.value(np.where(hit, k, 0), at), hit

        def nearest(k: np.ndarray) -> np.ndarray:
            """Distance of the k-th nearest value, by searching where the k nearest begin."""
            low, high = bounds[0].copy(), np.minimum(self.n - k, bounds[1])
            low = np.minimum(low, high)
            while True:
                at = np.flatnonzero(low < high)
                if not len(at):
                    break
                mid = (low[at] + high[at]) // 2
                left, left_known = known(mid, at)
                right, right_known = known(mid + k[at], at)
                further = centre[at] - left > right - centre[at]
                # Beyond the zones the answer is clear: the ends lie inside them.
                further = np.where(right_known, further, mid + k[at] < bounds[2][at])
                further = np.where(left_known, further, False)
                low[at], high[at] = np.where(further, mid + 1, low[at]), np.where(further, high[at], mid)
            everyone = np.arange(len(low))
            left, left_known = known(low, everyone)
            right, right_known = known(low + k - 1, everyone)
            return np.maximum(np.where(left_known, centre - left, -np.inf), np.where(right_known, right - centre, -np.inf))

        upper = nearest(self.n // 2 + 1)
        return np.where(self.n % 2 == 1, upper, (nearest(np.maximum(self.n // 2, 1)) + upper) / 2.0)


def block_mads(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK_ROWS) -> np.ndarray:
    """The median absolute deviation of values[s:e] for windows that never move back, in one task.

    The way of a ``Tile`` over an array: windows are taken in blocks whose edges hold at most ``block``
    rows, the rows that all windows of a block share are kept sorted, and of these only stretches
    as wide as the edges are looked at, around the medians and the two ends of the nearest halves.
    """
    order = np.argsort(values, kind="stable")
    ordered, rank = values[order], np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    shared, begin, end = np.zeros(len(values), bool), 0, 0
    out = np.empty(len(starts))
    number = (starts + ends) // block
    cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(starts)]
    for at, to in zip(cuts[:-1], cuts[1:]):
        s, e = starts[at:to].astype(np.int64), ends[at:to].astype(np.int64)
        left, right = int(s[-1]), int(max(e[0], s[-1]))
        shared[rank[begin:min(left, end)]] = False
        shared[rank[max(left, end):right]] = True
        begin, end = left, right
        edge = np.concatenate([rank[s[0]:left], rank[right:max(right, e[-1])]])
        out[at:to] = _block(ordered, np.flatnonzero(shared), edge, s - s[0], left - s[0] + e - right, e - s)
    return out


def _block(ordered: np.ndarray, core: np.ndarray, edge: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """MADs of the windows ``core`` + edge[first:last], both given as ranks, ``core`` sorted."""
    edges = len(edge)

    def hand(*parts: tuple[int, int]):
        """Values by place in a window, for places whose core rows lie in a part; one function for each part."""
        spans, taken, missing = [], [], []
        upto = gap = 0
        for low, high in parts:
            low = min(max(low, upto), len(core))
            high = min(max(high, low), len(core))
            gap += low - upto
            upto = high
            spans.append(core[low:high])
            missing.append(gap)
        known = np.sort(np.concatenate([*spans, edge]))
        places = [np.searchsorted(known, part) for part in (edge, np.concatenate(spans))]
        stretch, taken = RankedStretch(*places, len(known)), ordered[known]
        return [lambda k, on, skipped=m: taken[stretch.select(first[on], last[on], k - skipped)] for m in missing]

    everyone = np.arange(len(n))
    (value,) = hand((int((n.min() - 1) // 2) - edges, int(n.max() // 2) + 1))
    centre = (value((n - 1) // 2, everyone) + value(n // 2, everyone)) / 2.0

    # A place of a window lies between the same place of the core and the one as many rows before as
    # there are edges. Ends of the nearest halves lie where this leaves open which side is nearer.
    least, most, short, long = centre.min(), centre.max(), int(n.min() // 2), int(n.max() // 2) + 1

    def at(place: int) -> float:
        return -np.inf if place < 0 else np.inf if place >= len(core) else ordered[core[place]]

    def first_place(settled) -> int:
        low, high = 0, int(n.max()) - short
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if settled(mid) else (mid + 1, high)
        return low

    from_, upto = (first_place(lambda p: not least - at(p) > at(p + long) - least),
                   first_place(lambda p: most - at(p - edges) <= at(p + short - edges) - most))
    lower, upper = hand((from_ - edges, upto + 2), (from_ + short - 1 - edges, upto + long + 2))

    def nearest(k: np.ndarray, low: np.ndarray, high: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the k nearest values begin, and the distance of the furthest of them."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid, own = (low[open_] + high[open_]) // 2, on[open_]
            further = centre[own] - lower(mid, own) > upper(mid + k[open_], own) - centre[own]
            low[open_], high[open_] = np.where(further, mid + 1, low[open_]), np.where(further, high[open_], mid)
        return low, np.maximum(centre[on] - lower(low, on), upper(low + k - 1, on) - centre[on])

    k = n // 2 + 1
    low, mads = nearest(k, np.minimum(from_, n - k), np.minimum(upto, n - k), everyone)
    even = np.flatnonzero(n % 2 == 0)
    if len(even):
        # The nearest without the furthest of them begin at the same place or one behind.
        _, inner = nearest(k[even] - 1, low[even], low[even] + 1, even)
        mads[even] = (inner + mads[even]) / 2.0
    return mads


def _fresh(df: DataFrame) -> DataFrame:
    """The same table with columns of its own, so that two tables of one origin can meet."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each quarter tile: how many rows up to its end each bucket has."""
    counts = rows.groupBy("gid", "t", "b").agg(F.count(F.lit(1)).alias("c"))
    grid = sizes.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), "last_t")).alias("t"), "last_b").select(
        "gid", "t", F.explode(F.sequence(F.lit(0).cast("long"), "last_b")).alias("b"))
    along = Window.partitionBy("gid", "b").orderBy("t")
    upto = grid.join(counts, ["gid", "t", "b"], "left").select(
        "gid", "t", "b", F.sum(F.coalesce("c", F.lit(0))).over(along).alias("c"))
    return stored(upto.groupBy("gid", "t").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("l")).select(
        "gid", (F.col("t") + 1).alias("t"), F.col("l.c").alias("upto")))


def _tiles(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per tile: its windows' reach, its core in quarter tiles, and the core's counts per bucket."""
    quarter = F.col("quarter")
    tiles = rows.filter("s IS NOT NULL").groupBy("gid", "tile", "size", "quarter").agg(
        F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("e").alias("e0"), F.max("e").alias("e1"),
        F.min(F.col("e") - F.col("s")).alias("n0"), F.max(F.col("e") - F.col("s")).alias("n1"))
    t0, t1 = F.ceil(F.col("s1") / quarter), F.floor(F.col("e0") / quarter)
    none = t1 <= t0
    tiles = tiles.withColumns({
        "t0": F.when(none, F.floor(F.col("s0") / quarter)).otherwise(t0),
        "t1": F.when(none, F.floor(F.col("s0") / quarter)).otherwise(t1)})
    tiles = tiles.withColumns({"left": F.col("t0") * quarter, "right": F.greatest(F.col("t1") * quarter, F.col("s0"))})
    upto = _cells(rows, sizes)
    edges = rows.groupBy("gid", "b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).groupBy("gid").agg(
        F.array_sort(F.collect_list(F.struct("b", "lo", "hi"))).alias("l")).select("gid", F.col("l.lo").alias("lo"), F.col("l.hi").alias("hi"))
    tiles = attach(tiles, upto.select("gid", F.col("t").alias("t1"), F.col("upto").alias("u1")), ["gid", "t1"])
    tiles = attach(tiles, upto.select("gid", F.col("t").alias("t0"), F.col("upto").alias("u0")), ["gid", "t0"])
    tiles = attach(tiles, edges, ["gid"])
    nothing = F.transform("lo", lambda _: F.lit(0).cast("long"))
    base = F.zip_with(F.coalesce("u1", nothing), F.coalesce("u0", nothing), lambda a, b: a - b)
    tiles = tiles.withColumn("base", base).drop("u0", "u1")
    edge_rows = F.greatest(F.col("left") - F.col("s0"), F.lit(0)) + F.greatest(F.col("e1") - F.col("right"), F.lit(0))
    return tiles.withColumn("edge_rows", edge_rows)


def _with_median_buckets(tiles: DataFrame) -> DataFrame:
    """Lowest and highest bucket of a tile's medians: its edge rows may all lie below them, or none."""
    names = [f.name for f in tiles.schema.fields]

    def plan(batches):
        for batch in batches:
            lowest, highest = [], []
            for base, edge, n0, n1 in zip(*(batch.column(c).to_pylist() for c in ("base", "edge_rows", "n0", "n1")), strict=True):
                upto = np.cumsum(base)
                lowest.append(min(int(np.searchsorted(upto, (n0 - 1) // 2 - edge, "right")), len(base) - 1))
                highest.append(min(int(np.searchsorted(upto, n1 // 2, "right")), len(base) - 1))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lowest, pa.int64()), pa.array(highest, pa.int64())], [*names, "b0", "b1"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema.fields)
    return stored(tiles.mapInArrow(plan, schema + ", b0 long, b1 long"))


def _read_core(rows: DataFrame, wanted: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Core rows of the buckets that tiles ask for: ``wanted`` has gid, b, t0, t1 and the columns to keep."""
    found = grid_join(rows.select("gid", "b", "t", "vrank", "v"), wanted.select("gid", "b", "t0", "t1", *keep), ["gid", "b"])
    return found.filter("t >= t0 AND t < t1").select("gid", *keep, F.lit(2).alias("kind"), "vrank", "v")


def _edge_rows(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows between a tile's core and the reach of its windows."""
    quarter = F.col("quarter")

    def side(low: str, high: str) -> DataFrame:
        parts = F.sequence(F.floor(F.col(low) / quarter), F.floor((F.col(high) - 1) / quarter))
        return tiles.filter(F.col(low) < F.col(high)).select(
            "gid", "tile", F.col(low).alias("from"), F.col(high).alias("to"), F.explode(parts).alias("t"))

    wanted = side("s0", "left").union(side("right", "e1"))
    found = grid_join(rows.select("gid", "t", "rank", "vrank", "v"), wanted, ["gid", "t"])
    return found.filter("rank >= from AND rank < to").select("gid", "tile", F.lit(1).alias("kind"), "rank", "vrank", "v")


def _short_windows(rows: DataFrame, limit: int, spread: bool) -> DataFrame:
    """(gid, rank, median, mad) where no window is longer than ``limit``.

    Tiles are cut where rank + s + e passes a multiple of 3 * limit, so the windows of a tile reach over
    at most 4 * limit rows, which its task holds.
    """
    blocked = rows.withColumns({"t": F.floor(F.col("rank") / limit), "tile": F.floor((F.col("rank") + F.col("s") + F.col("e")) / (3 * limit))})
    queries = blocked.filter("s IS NOT NULL").select("gid", "tile", F.lit(0).alias("kind"), "rank", "s", "e")
    reach = queries.groupBy("gid", "tile").agg(F.min("s").alias("from"), F.max("e").alias("to"))
    wanted = reach.select("*", F.explode(F.sequence(F.floor(F.col("from") / limit), F.floor((F.col("to") - 1) / limit))).alias("t"))
    held = _fresh(blocked.select("gid", "t", "rank", "v")).join(stored(wanted), ["gid", "t"]).filter(
        "rank >= from AND rank < to").select("gid", "tile", F.lit(1).alias("kind"), "rank", "v")

    def solve(hand: pa.Table) -> pa.Table:
        kind, rank, v = (hand[c].to_numpy(zero_copy_only=False) for c in ("kind", "rank", "v"))
        at = np.flatnonzero(kind == 1)
        places = np.zeros(len(kind), np.int64)
        places[at[np.lexsort((rank[at], v[at]))]] = np.arange(len(at))
        # One bucket, all of it at hand as edge rows.
        whole = {"size": len(at) + 1, "lo": [-np.inf], "hi": [np.inf], "base": [0]}
        tile = Tile(hand.append_column("vrank", pa.array(places)), whole)
        medians = tile.medians(0)
        mads = tile.deviations(medians, (0, 1, 1, 1)) if spread else np.zeros(len(medians))
        return pa.table({"gid": pa.array([hand["gid"][0].as_py()] * len(medians), pa.string()), "rank": tile.rank, "median": medians, "mad": mads})

    hand = queries.unionByName(held, allowMissingColumns=True)
    return hand.groupBy("gid", "tile").applyInArrow(solve, "gid string, rank long, median double, mad double")


def window_medians(rows: DataFrame, keys: Sequence[str], limit: int, spread: bool = False) -> DataFrame:
    """(keys, rank, median[, mad]) of the rows that have a window.

    ``rows`` has the keys, ``rank`` (0, 1, ... in each group), ``v`` (a finite double) and the
    window ``s``, ``e`` in ranks, null for rows without one; s and e never fall along the rank.
    ``mad`` is the unscaled median absolute deviation.
    """
    keys = list(keys)
    # One key without nulls stands for the group.
    rows = rows.select(*keys, "rank", "v", "s", "e").withColumn("gid", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    facts = rows.groupBy("gid").agg(
        *[F.first(k).alias(k) for k in keys], F.count(F.lit(1)).alias("n"), F.max(F.col("e") - F.col("s")).alias("longest"))
    names = stored(facts)
    if (names.agg(F.max("longest")).first()[0] or 0) <= limit:
        found = attach(_short_windows(rows, limit, spread), names.drop("n", "longest"), ["gid"])
        return found.select(*keys, "rank", "median", *(["mad"] if spread else []))
    names = names.drop("longest")
    size = F.greatest(F.lit(limit), F.ceil(F.col("n") / MOST_TILES)).cast("long")
    sizes = names.select("gid", "n", size.alias("size"), F.ceil(size / 4).alias("quarter"))
    ranked = with_tiles(rows.select("gid", "rank", "v", "s", "e"), ["gid"], ["v", "rank"], limit, rank_as="vrank").drop("__tile")
    placed = attach(ranked, sizes.drop("n"), ["gid"])
    rows = stored(placed.withColumns({
        "t": F.floor(F.col("rank") / F.col("quarter")), "b": F.floor(F.col("vrank") / F.col("size")),
        "tile": F.floor((F.col("rank") + F.col("s") + F.col("e")) / F.col("size"))}))
    sizes = sizes.withColumns({"last_t": F.floor((F.col("n") - 1) / F.col("quarter")), "last_b": F.floor((F.col("n") - 1) / F.col("size"))})
    tiles = _with_median_buckets(_tiles(rows, sizes))

    queries = rows.filter("s IS NOT NULL").select("gid", "tile", F.lit(0).alias("kind"), "rank", "s", "e")
    edges = _edge_rows(rows, tiles)
    if spread:
        edges = stored(edges)
    wanted = tiles.select("gid", "tile", "t0", "t1", F.explode(F.sequence("b0", "b1")).alias("b")).filter("t0 < t1")
    hand = queries.unionByName(edges, allowMissingColumns=True).unionByName(
        _read_core(rows, wanted, ["tile"]), allowMissingColumns=True)
    facts = tiles.select("gid", "tile", "size", "base", "lo", "hi", "b0", "t0", "t1")

    def solve(hand: pa.Table, facts: pa.Table) -> pa.Table:
        given = facts.to_pylist()[0]
        tile = Tile(hand, given)
        medians = tile.medians(given["b0"])
        runs = tile.runs(medians) if spread else [(np.arange(len(medians)), (0, 0, 0, 0))]
        parts = []
        for number, (own, zone) in enumerate(runs):
            size = len(own)
            parts.append(pa.table({
                "kind": np.zeros(size, np.int32), "run": np.full(size, number, np.int32), "rank": tile.rank[own], "s": tile.s[own],
                "e": tile.e[own], "median": medians[own], "zone": pa.nulls(size, pa.list_(pa.int64()))}))
            parts.append(pa.table({
                "kind": np.full(1, 3, np.int32), "run": np.full(1, number, np.int32), "rank": pa.nulls(1, pa.int64()), "s": pa.nulls(1, pa.int64()),
                "e": pa.nulls(1, pa.int64()), "median": pa.nulls(1, pa.float64()), "zone": pa.array([list(zone)], pa.list_(pa.int64()))}))
        out = pa.concat_tables(parts)
        return out.add_column(0, "tile", pa.array([given["tile"]] * len(out), pa.int64())).add_column(
            0, "gid", pa.array([given["gid"]] * len(out), pa.string()))

    found = stored(hand.groupBy("gid", "tile").cogroup(_fresh(facts).groupBy("gid", "tile")).applyInArrow(
        solve, "gid string, tile long, kind int, run int, rank long, s long, e long, median double, zone array<long>"))
    own = found.filter("kind = 0")
    if not spread:
        return attach(own.select("gid", "rank", "median"), names.drop("n"), ["gid"]).select(*keys, "rank", "median")

    zones = found.filter("kind = 3").select("gid", "tile", "run", "zone")
    asked = zones.join(tiles.select("gid", "tile", "t0", "t1"), ["gid", "tile"]).filter("t0 < t1")
    ranges = F.array_union(*[F.when(F.col("zone")[i] < F.col("zone")[i + 1], F.sequence(F.col("zone")[i], F.col("zone")[i + 1] - 1)).otherwise(
        F.array().cast("array<long>")) for i in (0, 2)])
    core = _read_core(rows, asked.select("gid", "tile", "run", "t0", "t1", F.explode(ranges).alias("b")), ["tile", "run"])
    hand = own.select("gid", "tile", "run", F.lit(0).alias("kind"), "rank", "s", "e", "median").unionByName(
        grid_join(edges, zones.select("gid", "tile", "run"), ["gid", "tile"]), allowMissingColumns=True).unionByName(core, allowMissingColumns=True)
    facts = zones.join(tiles.select("gid", "tile", "size", "base", "lo", "hi"), ["gid", "tile"])

    def widths(hand: pa.Table, facts: pa.Table) -> pa.Table:
        given = facts.to_pylist()[0]
        tile = Tile(hand, given)
        centre = hand.filter(pa.compute.equal(hand["kind"], 0)).sort_by("rank")["median"].to_numpy()
        mad = tile.deviations(centre, tuple(given["zone"]))
        return pa.table({"gid": pa.array([given["gid"]] * len(mad), pa.string()), "rank": tile.rank, "median": centre, "mad": mad})

    cell = ["gid", "tile", "run"]
    out = hand.groupBy(*cell).cogroup(_fresh(facts).groupBy(*cell)).applyInArrow(widths, "gid string, rank long, median double, mad double")
    return attach(out, names.drop("n"), ["gid"]).select(*keys, "rank", "median", "mad")
