"""I-Match fingerprints over an inverse-document-frequency band.

Terms are lower-cased words. The lexicon keeps the terms whose share of documents lies in
[``low``, ``high``]: too common and too rare ones say nothing stable about a document. A
document's distinct lexicon terms are sorted and hashed, once for each of several randomised
subsets of the lexicon (a term is in a subset if a seeded hash says so), so that one changed
term spares the subsets without it. The likeness of two fingerprints is the share of equal
subset hashes.

The lower bound also bounds the lexicon: at most (mean distinct terms per document) / ``low``
terms can reach it, whatever the number of documents, so it is sent to the tasks.

Copies count as documents, so a large group of near copies lifts its own terms out of the
band. A text with fewer than ``FEW_TERMS`` lexicon terms is therefore hashed by all its
distinct terms, in randomised subsets as well.

Defined results: null text is empty; a text without terms is hashed by its characters, so equal texts always agree and empty
texts are alike; the next document after the smallest id is the largest one; null ids come
last in descending order, ties are ordered by text; a single document is its own next one;
an empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossfield.llm.common import materialize, text_of
from crossfield.llm.registry import documents, register

LOW, HIGH = 0.002, 0.1
SUBSETS = 16
KEEP_PERCENT = 60
# Below this many lexicon terms a text is hashed by all its terms.
FEW_TERMS = 8
# Seeds that deal all terms of a text to the subsets.
DEAL = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(SUBSETS)], dtype=np.uint64)
# Distinct terms counted in a task before their counts are handed on.
FLUSH_TERMS = 500_000
# Documents per range when neighbours in id order are paired; ranges are at most MAX_RANGES.
RANGE_DOCUMENTS = 20_000
MAX_RANGES = 10_000


def terms_of(text: str) -> set[bytes]:
    return set(text.encode().lower().split())


def document_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many documents each term occurs; the empty term counts all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column("text"):
                counts.update(set(value.as_py().lower().split()))
                counts[b""] += 1
                if len(counts) > FLUSH_TERMS:
                    yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
                    counts = Counter()
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    parts = df.select(text_of(text).cast("binary").alias("text")).mapInArrow(run, "term binary, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms of the band; their number is bounded by the lower bound."""
    counts = materialize(document_counts(df, text), "term-counts")
    total = counts.filter(F.octet_length("term") == 0).agg(F.sum("n").alias("t"))
    return counts.filter(F.octet_length("term") > 0).crossJoin(F.broadcast(total)).filter(
        (F.col("n") >= low * F.col("t")) & (F.col("n") <= high * F.col("t"))).select("term", "n")


class Fingerprinter:
    """Subset hashes of texts for one lexicon."""

    def __init__(self, terms: list[bytes]):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.number = {t: i for i, t in enumerate(sorted(terms))}
        self.codes = np.array([self.hash(t, 1) for t in sorted(terms)], dtype=np.uint64)
        self.member = np.array([[self.hash(t, 100 + k) % 100 < KEEP_PERCENT for k in range(SUBSETS)] for t in sorted(terms)], dtype=bool).reshape(-1, SUBSETS)

    def __call__(self, text: str) -> np.ndarray:
        terms = terms_of(text)
        known = terms & self.number.keys()
        if not terms:
            return np.array([self.hash(text.encode(), k) for k in range(SUBSETS)], dtype=np.uint64)
        if len(known) < FEW_TERMS:
            return self.of_all(terms)
        rows = np.array(sorted(self.number[t] for t in known))
        codes, member = self.codes[rows], self.member[rows]
        return np.array([self.hash(codes[member[:, k]].tobytes(), k) for k in range(SUBSETS)], dtype=np.uint64)

    def of_all(self, terms: set[bytes]) -> np.ndarray:
        """Subset hashes of all terms; a subset that gets none of them takes them all."""
        codes = np.sort(np.array([self.hash(t, 1) for t in terms], dtype=np.uint64))
        dealt = (codes[:, None] ^ DEAL) * np.uint64(0xBF58476D1CE4E5B9)
        member = (dealt ^ (dealt >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)
        member = member % np.uint64(100) < np.uint64(KEEP_PERCENT)
        member |= ~member.any(axis=0)
        return np.array([self.hash(codes[member[:, k]].tobytes(), 100 + k) for k in range(SUBSETS)], dtype=np.uint64)


def hexed(values: np.ndarray) -> str:
    return values.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_MADE: dict[str, Fingerprinter] = {}


def _fingerprinter(key: str, terms: list[bytes]) -> Fingerprinter:
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Fingerprinter(terms)
    return _MADE[key]


def _shared(spark: SparkSession, lex: DataFrame):
    """The (bounded) lexicon for the tasks, and a key for it."""
    terms = sorted(bytes(r["term"]) for r in lex.select("term").collect())
    key = hashlib.sha256(b" ".join(terms)).hexdigest()
    return key, spark.sparkContext.broadcast(terms)


def fingerprints(df: DataFrame, lex: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint): the subset hashes as hexadecimal digits."""
    key, terms = _shared(df.sparkSession, lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            make = _fingerprinter(key, terms.value)
            prints = [hexed(make(v)) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows dealt out so that every document meets the next one in descending id order.

    Ids are cut into ranges; each range also gets, as a guest, the first document of the
    next one (the last range that of the first). Columns: doc_id, text, part, guest.
    """
    ids = materialize(df.select(F.col(doc_id).alias("doc_id")), "ids")
    total = ids.count()
    n = max(1, min(MAX_RANGES, -(-total // RANGE_DOCUMENTS)))
    order = F.struct(F.col("doc_id").isNull(), -F.col("doc_id"))
    bounds = []
    if n > 1:
        cut = ids.filter("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("q")).first()["q"]
        bounds = sorted(set(cut or []))
    # Range 0 has the largest ids; a bound belongs to the range of larger ids.
    inside = F.lit(0)
    at = F.array(*[F.lit(b) for b in bounds]) if bounds else None
    if bounds:
        inside = F.size(F.filter(at, lambda b: F.col("doc_id") < b))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(inside).cast("int")
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("part", part)
    heads = materialize(rows.groupBy("part").agg(F.min(F.struct(order.alias("o"), "text")).alias("h")).select(
        "part", F.col("h.o.col1").alias("none"), (-F.col("h.o.col2")).alias("doc_id"), F.col("h.text").alias("text")), "heads")
    ring = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy()))
    guests = heads.select("doc_id", "text", before.cast("int").alias("part"), F.lit(1).alias("guest"))
    both = rows.withColumn("guest", F.lit(0)).union(guests)
    return both.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")


def compare_edited(df: DataFrame, lex: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text, its edited text (second half from the next document's start) and their likeness.

    Columns: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    key, terms = _shared(df.sparkSession, lex)
    dealt = neighbours(df, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            make = _fingerprinter(key, terms.value)
            out = []
            for own, value, part, guest in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")]):
                now = make(value)
                if last is not None and last[2] == part:
                    before, old, _, seen = last
                    half = len(old) // 2
                    edited = old[:len(old) - half] + value[:half]
                    changed = make(edited)
                    out.append((before, len(old), edited, hexed(seen), hexed(changed), likeness(seen, changed), likeness(seen, now)))
                last = None if guest else (own, value, part, now)
            if out:
                columns = list(zip(*out))
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[
                    "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = df.schema[doc_id].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")


@register("op5_imatch")
def op5_imatch(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = compare_edited(docs, lexicon(docs))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
