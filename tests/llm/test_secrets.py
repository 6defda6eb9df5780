import hashlib
import random
import re

from cases import TABLES, nothing, tricky

import __spark_entry__ as entry
from crossfield.llm import automaton, secrets

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text) if LEAST[kind](m))


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "TOKEN", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH0123",
             "0123456789abcdef", "deadbeefdeadbeefdeadbeefdeadbeef", "é", "ſ", "\n", "xyz", ".", "-"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        data = text.encode()
        assert [s for s in secrets.in_code_points(data, secrets.find(data)) if s[1] < 3] == brute(text)


def test_added_rules():
    text = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1+" * 20 + "\n ghp_" + "aZ" * 18 + " AIza" + "x" * 35
    assert {secrets.KINDS[k] for _, k, _ in secrets.find(text.encode())} == {"private_key", "code_token", "map_key"}
    assert secrets.find(b"ghp_short AIza AKIA xoxb-1 the token is lost, secret: none") == []


def test_automaton_is_minimal_and_equals_a_regex():
    pattern = automaton.seq(automaton.text("ab"), automaton.many(automaton.chars("a-c"), 2), automaton.maybe(automaton.text("x")))
    found = automaton.compile_patterns([pattern], anywhere=False)
    assert len(found.next) == 7  # start, a, ab, one and two or more of the run, x, dead
    r, rx = random.Random(1), re.compile("ab[a-c]{2,}x?")
    for _ in range(500):
        text = "".join(r.choice("abcxy") for _ in range(12))
        assert automaton.spans(found, text.encode()) == [m.span() for m in rx.finditer(text)]


def test_awkward_rows(spark):
    df = tricky(spark)
    got = secrets.scan(df).collect()
    assert len(got) == df.count() and all(r["found"] == [] for r in got)
    assert secrets.scan(nothing(spark)).count() == 0


def test_query_counts_and_digests(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    kinds = list(PATTERNS)
    for r in entry.queries()["op10_secrets"](spark, TABLES).collect():
        spans = [f"{kinds[k]}:{a}:{b}" for a, k, b in brute(docs[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s.startswith(k) for s in spans) for k in kinds]
        assert set(spans) <= set(r["spans"].split(","))
