"""Repeated byte strings across documents by difference-cover sampling.

Removed is every byte covered by a ``LENGTH``-byte string that also starts in a document with
a smaller id. A full suffix order is not needed for that, only which suffixes agree in their
first ``LENGTH`` bytes, so the steps of the difference-cover algorithm are taken to that depth:

1. *Sampled triples.* Positions whose offset modulo ``PERIOD`` lies in the difference cover are
   sampled; each is keyed by a triple of symbols (8 + 8 + 4 = ``ANCHOR`` bytes). Any two
   positions have a shift below ``PERIOD`` that brings both onto sampled ones, so any two equal
   strings share a sampled triple at one place. Triples are dealt out by value and sorted;
   those of a single document drop out.
2. *Names.* The remaining triples are named by their value, and names a period apart are
   joined to names of ``LONG`` bytes: an equal long name of a smaller document covers the
   inside of a long match without looking at its single positions.
3. *Remaining suffixes.* Strings at the edges, which touch a shared triple but are not yet
   covered, make their triples active; wherever an active triple stands, in any document, all
   positions that reach it take part in the last step.
4. *Adjacent prefixes.* The ``LENGTH``-byte prefixes of these positions are sorted with their
   documents; each is compared with the smallest document of equal ones.

Texts are packed whole into blocks in a bucketed table (it stays in the session's catalog
under a name of its own, as the result reads it). A step sends, from each block to each
value range, one sorted array of distinct values (a value that is everywhere is sent once per
block), and gets back bits in the same order, so no match is ever listed as a pair. Values
are 64-bit mixes of the bytes (48 bits in the first step, which is a filter); two
different strings agree by chance with probability 2**-64 for each comparison.

Defined results: null text is empty; a document with a null id neither loses bytes nor takes
them from others; equal ids do not take bytes from each other; texts under ``LENGTH`` bytes
stay; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield.llm.common import materialize, new_path, text_of
from crossfield.llm.registry import documents, register

LENGTH = 50
# A perfect difference set: every difference modulo 31 occurs (fixed value).
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = LENGTH - PERIOD + 1
LONG = PERIOD + ANCHOR
# The first step is a filter and keeps the leading 48 bits of a value.
FILTER = np.uint64(2**64 - 2**16)
BLOCK_BYTES, BLOCK_DOCS = 2_000_000, 60_000
# Bytes of text per value range: about a fifth of them are sampled.
RANGE_BYTES = 8_000_000
FACTORS = tuple(np.uint64(f) for f in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class Block:
    """The bytes of some documents (by id), with positions and the hashes of stretches."""

    def __init__(self, ids: bytes, known: bytes, lens: bytes, data: bytes):
        self.ids, self.lens = np.frombuffer(ids, "<i8"), np.frombuffer(lens, "<i8")
        self.known = np.frombuffer(known, np.uint8).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])
        self.size = int(self.starts[-1])
        self.data = data
        padded = data + b"\0" * 16
        self.words = np.ndarray((self.size + 8,), "<u8", padded, strides=(1,))
        self.keep = padded
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        self.left = (self.starts[1:][self.doc] - np.arange(self.size)) * self.known[self.doc]

    def samples(self) -> np.ndarray:
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        offset = np.arange(self.size) - self.starts[self.doc]
        return np.flatnonzero(cover[offset % PERIOD] & (self.left >= ANCHOR))

    def hashes(self, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
        """64-bit mix of the ``length`` bytes from each position (the last load overlaps)."""
        out = np.empty(len(at), np.uint64)
        for a in range(0, len(at), 1_000_000):
            p = at[a:a + 1_000_000]
            h = np.full(len(p), salt + length, np.uint64)
            for k, skip in enumerate(range(0, length, 8)):
                h ^= self.words[p + min(skip, length - 8)] * FACTORS[k % 7]
                h = (h ^ (h >> np.uint64(29))) * FACTORS[(k + 3) % 7]
            out[a:a + 1_000_000] = h ^ (h >> np.uint64(32))
        return out

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Which positions start a string that holds one of the triples at ``at`` whole."""
        first = np.maximum(at - (PERIOD - 1), self.starts[self.doc[at]])
        return self.between(first, at + 1) & (self.left >= LENGTH)

    def between(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which positions lie in one of the stretches."""
        change = np.bincount(first, minlength=self.size + 1) - np.bincount(end, minlength=self.size + 1)
        return np.cumsum(change[:-1]) > 0

    def cover(self, covered: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return covered | self.between(at, at + length)


def _order(values: np.ndarray) -> np.ndarray:
    """A stable argsort. Leading bits of the values and their places in one number sort much faster;
    where leading bits agree and the rest does not, the plain sort decides."""
    mask = np.uint64((1 << len(values).bit_length()) - 1)
    packed = np.sort((values & ~mask) | np.arange(len(values), dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    ordered = values[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(values, kind="stable")


class Items:
    """Values of positions in a block, told apart once each; the first holder has the smallest id."""

    def __init__(self, block: Block, at: np.ndarray, values: np.ndarray):
        self.at = at
        order = _order(values)
        ordered = values[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]][:len(order)]
        self.values, first = ordered[new], order[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.holder = block.doc[at[first]] if len(at) else np.zeros(0, np.int32)
        own, least = block.ids[block.doc[at]], block.ids[self.holder][self.which] if len(at) else np.zeros(0, np.int64)
        self.later = own > least
        self.shared = np.zeros(len(self.values), bool)
        self.shared[self.which[own != least]] = True

    def late(self, bits: np.ndarray) -> np.ndarray:
        return self.later | bits[0][self.which]

    def elsewhere(self, bits: np.ndarray) -> np.ndarray:
        return (self.shared | bits[1])[self.which]


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of equal-weight bytes: equal bytes stand together for the shuffle's compression."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return (((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def asks(block: Block, items: Items, number: int, ranges: int, documents: bool, flags: np.ndarray | None) -> list[dict]:
    """What a block sends: per value range its distinct values, in order."""
    part = _range_of(items.values, ranges)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    rows = []
    for a, z in zip(cuts, [*cuts[1:], len(part)]):
        row = {"range": int(part[a]), "block": number, "vals": _planes(items.values[a:z]), "ids": None, "flags": None}
        if documents:
            row["ids"] = _planes(block.ids[items.holder[a:z]].view(np.uint64))
        if flags is not None:
            row["flags"] = np.packbits(flags[a:z]).tobytes()
        rows.append(row)
    return rows


def answer(rows: list[dict]) -> list[dict]:
    """For one value range: smaller document elsewhere, other block, flagged anywhere, per value sent."""
    values = [_unplaned(r["vals"]) for r in rows]
    sizes = [len(v) for v in values]
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    new = np.r_[True, every[order][1:] != every[order][:-1]]
    group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
    bits = np.zeros((3, len(every)), bool)
    bits[1][order] = np.diff(np.r_[begins, len(every)])[group] > 1
    if rows[0]["ids"] is not None:
        ids = np.concatenate([_unplaned(r["ids"]).view(np.int64) for r in rows])
        bits[0][order] = np.minimum.reduceat(ids[order], begins)[group] < ids[order]
    if rows[0]["flags"] is not None:
        flags = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=n) for r, n in zip(rows, sizes)])
        bits[2][order] = np.maximum.reduceat(flags[order], begins)[group] > 0
    ends = np.cumsum(sizes)
    return [{"block": r["block"], "range": r["range"], "bits": np.packbits(bits[:, z - n:z]).tobytes()} for r, n, z in zip(rows, sizes, ends)]


# Steps: how the state of a block follows from the answers, and what it asks next. The state
# is a stack of bits per byte: triple shared, triple later than another, byte covered, triple active.
SHARED, LATE, COVERED, ACTIVE = range(4)


def _items(step: int, block: Block, state: np.ndarray) -> tuple[Items, int]:
    """The values a block asks about in a step, and how many of the positions are triples."""
    if step == 1:
        at = block.samples()
        return Items(block, at, block.hashes(at, ANCHOR) & FILTER), len(at)
    if step == 4:
        at = np.flatnonzero(block.reach(np.flatnonzero(state[ACTIVE])))
        return Items(block, at, block.hashes(at, LENGTH)), 0
    at = np.flatnonzero(state[SHARED])
    values = block.hashes(at, ANCHOR)
    if step == 3:
        return Items(block, at, values), len(at)
    far = at[block.left[at] >= LONG]
    far = far[state[SHARED][far + PERIOD]]
    both = np.concatenate([at, far])
    order = np.argsort(both, kind="stable")
    # Sorted by position, so that the first holder of a value has the smallest id.
    items = Items(block, both[order], np.concatenate([values, block.hashes(far, LONG)])[order])
    items.long = (np.arange(len(both)) >= len(at))[order]
    return items, len(at)


def _flags(block: Block, state: np.ndarray, items: Items) -> np.ndarray:
    """Triples reached by a string that may be repeated and is not covered yet."""
    open_ = block.reach(np.flatnonzero(state[LATE]))
    done = np.concatenate([[0], np.cumsum(state[COVERED])])
    starts = np.flatnonzero(open_)
    starts = starts[done[starts + LENGTH] - done[starts] < LENGTH]
    seen = np.zeros(block.size + 1, np.int64)
    seen[starts + 1] = 1
    seen = np.cumsum(seen)
    touched = seen[items.at + 1] > seen[np.maximum(items.at - (PERIOD - 1), block.starts[block.doc[items.at]])]
    flags = np.zeros(len(items.values), bool)
    flags[items.which[touched]] = True
    return flags


def _settle(step: int, block: Block, state: np.ndarray, items: Items, bits: np.ndarray) -> np.ndarray:
    state = state.copy()
    if step == 1:
        state[SHARED][items.at] = items.elsewhere(bits)
    elif step == 2:
        late = items.late(bits)
        state[LATE][items.at[late & ~items.long]] = True
        state[COVERED] = block.cover(state[COVERED], items.at[late & items.long], LONG)
    elif step == 3:
        active = bits[2] | _flags(block, state, items)
        state[ACTIVE][items.at[active[items.which]]] = True
    else:
        state[COVERED] = block.cover(state[COVERED], items.at[items.late(bits)], LENGTH)
    return state


DOCUMENTS = {1: False, 2: True, 3: False, 4: True}
ASK = "range long, block long, vals binary, ids binary, flags binary"
ASK_ARROW = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("vals", pa.binary()), ("ids", pa.binary()), ("flags", pa.binary())])
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("bits", pa.binary())])


def _blocks(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))

    def pack(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is None, r[0] or 0))
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([np.array([r[0] or 0 for r in held], "<i8").tobytes()], pa.binary()),
            "known": pa.array([bytes([r[0] is not None for r in held])], pa.binary()),
            "lens": pa.array([np.array([len(r[1]) for r in held], "<i8").tobytes()], pa.binary()),
            "data": pa.array([b"".join([r[1] for r in held])], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for own, value in zip(batch.column("doc_id"), batch.column("text")):
                held.append((own.as_py(), value.as_py()))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(run, "ids binary, known binary, lens binary, data binary").withColumn("block", F.monotonically_increasing_id())


def _of(row: dict) -> Block:
    return Block(row["ids"], row["known"], row["lens"], row["data"])


def _state(row: dict, size: int) -> np.ndarray:
    if row.get("state") is None:
        return np.zeros((4, size), bool)
    return np.unpackbits(np.frombuffer(row["state"], np.uint8), count=4 * size).reshape(4, size).astype(bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _answers(step: int, blocks: DataFrame, ranges: int) -> DataFrame:
    """All blocks' questions of a step, answered per value range."""
    documents_sent = DOCUMENTS[step]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _of(row)
            state = _state(row, block.size)
            items, _ = _items(step, block, state)
            flags = _flags(block, state, items) if step == 3 else None
            sent = asks(block, items, row["block"], ranges, documents_sent, flags)
            yield pa.RecordBatch.from_pylist(sent, schema=ASK_ARROW)

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["range"] != row["range"]:
                yield pa.RecordBatch.from_pylist(answer(held), schema=ANSWER_ARROW)
                held = []
            held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(answer(held), schema=ANSWER_ARROW)

    dealt = blocks.mapInArrow(ask, ASK).repartition("range").sortWithinPartitions("range", "block")
    answers = materialize(dealt.mapInArrow(respond, "block long, range long, bits binary"), f"suffix-answers{step}")
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "bits"))).alias("answers"))


def _bits(items: Items, ranges: int, answers: list[dict] | None) -> np.ndarray:
    out = np.zeros((3, len(items.values)), bool)
    part = _range_of(items.values, ranges)
    for got in answers or []:
        a, z = np.searchsorted(part, [got["range"], got["range"] + 1])
        out[:, a:z] = np.unpackbits(np.frombuffer(got["bits"], np.uint8), count=3 * (z - a)).reshape(3, z - a)
    return out


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans (start, end) and the bytes that stay."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    ranges = max(16, -(-total // RANGE_BYTES))
    table, path = f"llm_blocks_{uuid.uuid4().hex}", new_path(spark, "suffix-blocks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed by block, so that answers join the texts without moving them.
    _blocks(df, doc_id, text).write.bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    blocks = spark.table(table)
    state = None

    def with_state(extra: DataFrame | None = None) -> DataFrame:
        out = blocks
        for other in (state, extra):
            if other is not None:
                out = out.join(other.hint("shuffle_hash"), "block", "left")
        return out

    def settled(step: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                block = _of(row)
                before = _state(row, block.size)
                items, _ = _items(step, block, before)
                after = _settle(step, block, before, items, _bits(items, ranges, row["answers"]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]]), "state": pa.array([np.packbits(after).tobytes()], pa.binary())})
        return run

    for step in (1, 2, 3, 4):
        answers = _answers(step, with_state(), ranges)
        state = materialize(with_state(answers).mapInArrow(settled(step), "block long, state binary"), f"suffix-state{step}")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _of(row)
            covered = _state(row, block.size)[COVERED]
            out = []
            for k, (a, n) in enumerate(zip(block.starts[:-1].tolist(), block.lens.tolist())):
                own = np.r_[False, covered[a:a + n], False]
                edges = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
                text_bytes = np.frombuffer(block.data, np.uint8)[a:a + n]
                out.append({"doc_id": int(block.ids[k]) if block.known[k] else None, "n_bytes": n,
                            "spans": [{"start": int(s), "end": int(e)} for s, e in edges], "kept": text_bytes[~own[1:-1]].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))

    return with_state().mapInArrow(results, "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary")


@register("op8_suffixes")
def op8_suffixes(spark, sf_dir):
    found = repeats(documents(spark, sf_dir).select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
