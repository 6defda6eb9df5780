import hashlib

import pytest
from cases import TABLES
from oracle_check import compare, connect

import __spark_entry__ as entry
from crossfield.llm import warc
from crossfield.llm.common import new_path

BIG, SMALL = "<p>" + "same page " * 30, "<p>short"
ROWS = [(5, "http://a/5", BIG), (2, "http://a/2\r\nX: 1", BIG), (9, None, BIG), (9, None, BIG), (None, "http://n", BIG), (1, "u", SMALL),
        (3, "u", SMALL), (4, "u", None), (6, "u", ""), (7, "ü", "é🙂" * 60), (8, "v", "é🙂" * 60), (10, "w", "x" * 300_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op9_warc"](spark, TABLES), connect(TABLES), entry.oracle_sql()["op9_warc"]) is None


@pytest.mark.parametrize("sizes", [{}, {"roll_bytes": 600, "range_bytes": 500}])
def test_round_trip(spark, sizes):
    path = new_path(spark, "warc-test")
    manifest = warc.write_archive(pages(spark), path, **sizes).collect()
    got = warc.read_archive(spark, path).collect()
    assert sum(m["records"] for m in manifest) == len(got) == len(ROWS)
    first = {hashlib.sha256(BIG.encode()).hexdigest(): 2, hashlib.sha256(("é🙂" * 60).encode()).hexdigest(): 7}
    for r in got:
        own = next(h for p, _, h in ROWS if p == r["page_id"])
        data = (own or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), digest)
        again = r["page_id"] is not None and first.get(digest, r["page_id"]) < r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[digest]) if again else ("response", None))
        assert r["payload"] == (None if again else data)
    assert sorted((r["page_id"] or 0 for r in got)) == sorted(p or 0 for p, _, _ in ROWS)


def test_archives_are_the_same_each_time(spark):
    written = []
    for parts in (1, 4):
        path = new_path(spark, "warc-test")
        written.append(sorted(map(tuple, warc.write_archive(pages(spark).repartition(parts), path, roll_bytes=600, range_bytes=500).collect())))
    assert written[0] == written[1] and len(written[0]) > 2


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload")
    head, block = next(warc.parse(data))
    assert warc._row(head, block)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc._row(head, block.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError):
        list(warc.members(warc.gzip.compress(data)[:-10]))


def test_empty_table(spark):
    path = new_path(spark, "warc-test")
    assert warc.write_archive(pages(spark, []), path).count() == 0
    assert warc.read_archive(spark, path).count() == 0


def test_the_query_rolls_files_by_compressed_size(spark, tmp_path):
    import random

    r = random.Random(3)
    pages = [(i, f"http://h/{i}", "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40_000))) for i in range(240)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.write_archive(df, f"file://{tmp_path}/rolled").orderBy("file").collect()
    assert len(rows) > 2 and len({m["range"] for m in rows}) == 1 and sum(m["records"] for m in rows) == 240
    assert all(m["bytes"] >= warc.ROLL_BYTES for m in rows[:-1])
