"""Small tables with the awkward cases, and brute-force versions of the operators."""

import random
import re

import xxhash

TABLES = "/root/testdata/sf0.001"
WORDS = "the of and river stone light valley garden window quiet morning paper silver north harbor".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, copies int, cut string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(words)]
    return "\n".join(" ".join(out[i:i + 12]) for i in range(0, words, 12))


def tricky_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        (0, base, "a"), (1, near, "a"), (2, base, "b"), (3, "", "a"), (4, None, "a"), (None, base, "a"), (None, None, None),
        (5, "one two", None), (6, "one two", None), (6, "one two", None), (7, prose(2, 6000), "a"), (8, "x" * 50_000, "b"),
        (9, " \t\n \n", "a"), (10, prose(3, 30) + "\n" + "\n".join(base.split("\n")[2:7]), "c"), (11, "é🙂 " * 30, "ü"),
        (12, prose(4, 25), ""), (13, prose(5, 25), "a"), (14, "the same words again " * 12, "a"), (15, prose(5, 24), "a"),
    ]
    return [(d, t, None if (d or 0) % 3 else "en", s, len(t or ""), "extra", None, -1, "k") for d, t, s in texts]


def tricky(spark):
    return spark.createDataFrame(tricky_rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = bytes((text or "").encode()).lower().split()
    return [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def simhash(text, k=3):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, links):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
