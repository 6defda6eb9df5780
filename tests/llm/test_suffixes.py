import hashlib

import pytest
from cases import TABLES, nothing, prose, tricky, tricky_rows

import __spark_entry__ as entry
from crossfield.llm import suffixes


def brute(rows):
    """Kept bytes and number of spans of (id, text) rows."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            s = b[i:i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        out.append((d, len(b), bytes(x for x, g in zip(b, gone) if not g), sum(g and not p for g, p in zip(gone, b"\0" + gone))))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in suffixes.repeats(df).collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [2_000_000, 4_000])
def test_awkward_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block_bytes)
    assert result(tricky(spark)) == brute([(r[0], r[1]) for r in tricky_rows()])


def test_matches_of_all_lengths_and_alignments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3_000)
    base = prose(50, 700).encode().decode()
    rows = [(0, base)]
    for k in range(60):
        length = 45 + k * 3
        rows.append((k + 1, prose(100 + k, 20)[:k] + base[k * 37:k * 37 + length] + prose(300 + k, 10)))
    rows += [(90, "z" * 400), (91, "z" * 49), (92, "z" * 50), (93, "az" * 30), (94, "za" * 40)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_query_digests(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    want = {d: (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for d, n, kept, spans in brute(rows)}
    assert any(w[1] for w in want.values())
    assert {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op8_suffixes"](spark, TABLES).collect()} == want


def test_empty_table(spark):
    assert suffixes.repeats(nothing(spark)).count() == 0
