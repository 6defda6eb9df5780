"""Deterministic sharded WARC writer and reader.

Writing: record lengths are summed along the order of page ids (per sorted partition, then
over the partitions), which cuts the ids into ranges of about ``range_bytes`` (at most
``MAX_RANGES``, so the list of range starts that tasks receive is bounded). One task writes a
range in id order; every record is a gzip member of its own, and a file ends once its
compressed size reaches ``roll_bytes``. Names, order, headers, digests and bytes depend on
the pages alone, so a repeated attempt writes the same files: each is written under a
temporary name of its attempt and renamed when complete. The manifest (file, range, records,
bytes, SHA-256) is committed by Spark after all files are in place; readers take the files
that it lists, and check every payload against its digest.

Payloads of at least ``min_revisit`` bytes that occur again are written as revisit records
without the payload; they refer to the response of the smallest page id. The HTTP header of
a revisit keeps the length of the full payload.

Defined results: null payload is empty; null url gives no target header; null ids are
written first, always as responses, and nothing refers to them; rows that agree in id and
payload are each written, with equal types; an empty table gives an archive without files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfield.llm.common import materialize, new_path, text_of
from crossfield.llm.registry import register

MIN_REVISIT = 100
# Compressed; a range of pages takes several files.
ROLL_BYTES = 2 * 1024 * 1024
RANGE_BYTES = 16 * 1024 * 1024
MAX_RANGES = 10_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, range long, records long, bytes long, sha256 string"


def _name(page: object, digest: str) -> str:
    return f"<urn:page:{'null' if page is None else page}:{digest[:16]}>"


def _plain(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One uncompressed WARC record: a response, or a revisit if it refers to another page."""
    digest = hashlib.sha256(payload).hexdigest()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _plain(url)))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to, digest))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stretch of records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        size = int(head["content-length"])
        yield head, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    while data:
        part = zlib.decompressobj(wbits=31)
        out = part.decompress(data) + part.flush()
        if not part.eof:
            raise ValueError("the file ends inside a record")
        yield out
        data = part.unused_data


class _Shard:
    """Writes the files of one range: temporary name first, final name when complete."""

    def __init__(self, fs, folder: str, part: int, roll_bytes: int):
        self.fs, self.folder, self.part, self.roll = fs, folder, part, roll_bytes
        self.count, self.stream, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temporary)
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        packed = gzip.compress(data, mtime=0)
        self.stream.write(packed)
        self.sha.update(packed)
        self.size, self.records = self.size + len(packed), self.records + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        name = f"part-{self.part:06d}-{self.count:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.folder}/files/{name}")
        self.count += 1
        self.done.append((name, self.part, self.records, self.size, self.sha.hexdigest()))


def _range_starts(meta: DataFrame, range_bytes: int) -> list:
    """First page id of every range after the first, by running sums of bytes along the ids."""
    order = ["page", "digest"]
    ranged = materialize(meta.filter("page IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).select(
        "page", "bytes", F.monotonically_increasing_id().alias("at")), "warc-order").withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("part").agg(F.sum("bytes").alias("n"))
    ahead = parts.select(F.col("part").alias("p"), F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    own = F.coalesce(F.sum("bytes").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = F.greatest(F.lit(range_bytes), F.ceil(F.col("total") / MAX_RANGES))
    placed = ranged.withColumn("own", own).join(ahead, F.col("part") == F.col("p")).withColumn(
        "range", F.floor((F.col("ahead") + F.col("own")) / width))
    starts = placed.groupBy("range").agg(F.min("page").alias("page")).filter("range > 0")
    return sorted(r["page"] for r in starts.collect())


def write_archive(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str | Column = "html",
                  min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write one record per row below ``path``; the committed manifest."""
    data = text_of(payload).cast("binary")
    rows = df.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    meta = materialize(rows.select("page", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "warc-meta")
    firsts = meta.filter((F.col("bytes") >= min_revisit) & F.col("page").isNotNull()).groupBy("digest").agg(
        F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("f_digest"), "first")
    revisits = meta.join(firsts, F.col("digest") == F.col("f_digest")).filter("page > first").select("page", "digest", "first").distinct()
    starts = _range_starts(meta, range_bytes)
    at = np.array(starts, dtype=object if starts and isinstance(starts[0], str) else None)

    @F.pandas_udf(T.LongType())
    def range_of(pages):
        found = np.zeros(len(pages), np.int64)
        known = pages.notna().to_numpy()
        if len(at):
            found[known] = np.searchsorted(at, pages[known].to_numpy().astype(at.dtype), side="right")
        return __import__("pandas").Series(found)

    notices = revisits.select("page", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                              F.lit(0).alias("kind"), "digest", "first")
    records = rows.select("page", "url", "payload", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"),
                          F.lit(None).cast(meta.schema["page"].dataType).alias("first"))
    # Pages and the notices that some of them are revisits meet in the task of their range.
    both = notices.union(records).withColumn("range", range_of("page"))
    dealt = both.repartition("range").sortWithinPartitions("range", "page", "kind", "digest", F.octet_length("payload"), "payload")
    uri = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(uri)
        shard, page, noted = None, None, {}
        done = []
        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "payload", "kind", "digest", "first", "range")]
            for i in range(batch.num_rows):
                own, link, body, kind, digest, first, part = (c[i].as_py() for c in columns)
                if shard is None or shard.part != part:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = _Shard(fs, folder, part, roll_bytes)
                    fs.create_dir(f"{folder}/_temporary", recursive=True)
                    fs.create_dir(f"{folder}/files", recursive=True)
                if own != page:
                    page, noted = own, {}
                if kind == 0:
                    noted[digest] = first
                    continue
                refers_to = noted.get(hashlib.sha256(body).hexdigest()) if noted else None
                shard.add(record(own, link, body, refers_to))
        if shard is not None:
            shard.close()
            done += shard.done
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "range", "records", "bytes", "sha256"), d)) for d in done], schema=pa.schema(
            [("file", pa.string()), ("range", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_archive(spark: SparkSession, path: str, page_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the manifest's files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    fields = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    if manifest.isEmpty():
        return spark.createDataFrame([], fields).withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})
    files = spark.read.format("binaryFile").load(f"{path}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = files.join(manifest.select(F.col("file").alias("m_file"), "sha256"), F.col("file") == F.col("m_file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content, sha in zip(batch.column("content"), batch.column("sha256").to_pylist()):
                content = content.as_py()
                if hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError("a file differs from its manifest")
                rows = []
                for member in members(content):
                    rows += [_row(head, block) for head, block in parse(member)]
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    page = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(page_type)
    return listed.select("content", "sha256").mapInArrow(run, fields).withColumns({c: page(c) for c in ("page_id", "refers_to")})


def _row(head: dict[str, str], block: bytes) -> dict:
    if head["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"damaged record {head['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    revisit = head["warc-type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {head['warc-record-id']}")
    length = next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
    page = lambda name: head[name][len("<urn:page:"):].rpartition(":")[0] if name in head else None
    return {"page_id": page("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "refers_to": page("warc-refers-to"), "payload_bytes": int(length.split(":")[1]), "payload_digest": digest,
            "payload": None if revisit else payload}


@register("op9_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM f
""")
def op9_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
