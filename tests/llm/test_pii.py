import hashlib
import random
import re

from cases import TABLES, nothing, tricky
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crossfield.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(3)
    parts = ["a@b", ".c", "@", "x.y", "user", ".com", "1.2.3.4", "255", ".", "999", "0", "4111111111111111", "4111 1111-1111 1111", "12", " ",
             "-", "+1 (555) 123-4567", "+", "(", "é", "🙂", "\n", "555-123-4567 ", "call ", "_", "%", "7"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)] + ["a" * 30_000 + "@", "1." * 5000, "+1" + " " * 20_000, "a@b" + ".c" * 5000]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = dict(found.select("doc_id", pii.listed(F.filter("found", lambda s: s["base"]))).collect())
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_labelers_add_spans_with_context_only(spark):
    rows = [(i, f"mail me at user{i}@host.com or +1 (555) 100-20{i:02d} today") for i in range(60)]
    rows += [(100 + i, f"please call 555-123-40{i:02d} now") for i in range(30)] + [(200 + i, f"order 555-123-40{i:02d} was built") for i in range(30)]
    rows += [(300 + i, f"number 41111111111111{i:02d} here") for i in range(30) if not luhn(f"41111111111111{i:02d}")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r["doc_id"]: {s["kind"] for s in r["found"]} for r in found}
    assert all(by[i] == {"email", "phone"} for i in range(60))
    assert all(by[100 + i] == {"local_phone"} for i in range(30))
    assert all(by[200 + i] == set() for i in range(30))
    assert not any(kinds for d, kinds in by.items() if d >= 300)


def test_awkward_rows(spark):
    df = tricky(spark)
    got = pii.find(df).collect()
    assert len(got) == df.count() and all(r["found"] == [] for r in got)
    assert pii.find(nothing(spark)).count() == 0


def test_query_counts_and_digests(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    for r in entry.queries()["op4_pii"](spark, TABLES).collect():
        base = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in base.split(",")) for k in PATTERNS]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
