import hashlib
from collections import Counter

import pytest
from cases import TABLES, nothing, prose, tricky, tricky_rows

import __spark_entry__ as entry
from crossfield.llm import imatch


def brute(rows, terms):
    """(id, n_chars, edited, three prints and two likenesses) in descending id order."""
    make, out = imatch.Fingerprinter(terms), []
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = make(t), make(edited), make(after)
        out.append((d, len(t), edited, imatch.hexed(a), imatch.hexed(b), imatch.likeness(a, b), imatch.likeness(a, c)))
    return out


@pytest.mark.parametrize("range_documents", [20_000, 17])
def test_query_equals_brute_force(spark, monkeypatch, range_documents):
    monkeypatch.setattr(imatch, "RANGE_DOCUMENTS", range_documents)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    counts = Counter(t for _, text in rows for t in imatch.terms_of(text))
    terms = [t for t, n in counts.items() if imatch.LOW * len(rows) <= n <= imatch.HIGH * len(rows)]
    want = {d: (n, hashlib.sha256(e.encode()).hexdigest(), *rest) for d, n, e, *rest in brute(rows, terms)}
    got = {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["op5_imatch"](spark, TABLES).collect()}
    assert got == want


def test_likeness_falls_with_edits(spark):
    terms = [f"t{i}".encode() for i in range(300)]
    make = imatch.Fingerprinter(terms)
    text = " ".join(f"t{i}" for i in range(0, 300, 5))
    near = [imatch.likeness(make(text), make(" ".join(text.split()[k:]))) for k in (0, 1, 4, 30)]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] >= near[3] < 0.1


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_DOCUMENTS", 4)
    df = tricky(spark)
    lex = imatch.lexicon(df, low=0.1, high=0.9)
    terms = [bytes(r["term"]) for r in lex.collect()]
    assert terms
    want = brute([(r[0], r[1] or "") for r in tricky_rows()], terms)
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(imatch.compare_edited(df, lex).collect()) == order(want)
    by = {(r["doc_id"], r["fingerprint"]) for r in imatch.fingerprints(df, lex).collect()}
    assert by == {(r[0], r[3]) for r in want}


def test_empty_and_single(spark):
    empty = nothing(spark)
    assert imatch.compare_edited(empty, imatch.lexicon(empty)).count() == 0
    one = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    row = imatch.compare_edited(one, imatch.lexicon(one)).first()
    assert (row["edited"], row["near_next"]) == ("alonealone", 1.0)


def test_near_copies_that_hold_a_third_of_the_rows_stay_alike(spark):
    base = prose(77, 200).split()
    group = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1:]) for k in range(100)]
    rows = list(enumerate(group + [prose(500 + k, 200) for k in range(200)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    make = imatch.Fingerprinter([bytes(r["term"]) for r in imatch.lexicon(df).collect()])
    prints = [make(t) for t in group]
    near = [imatch.likeness(a, b) for a, b in zip(prints, prints[1:])]
    apart = [imatch.likeness(prints[k], make(rows[100 + k][1])) for k in range(100)]
    dropped = [imatch.likeness(make(" ".join(base)), make(" ".join(base[:k] + base[k + 1:]))) for k in range(100)]
    assert sum(near) / len(near) > 0.02 and sum(dropped) / len(dropped) > 0.3 and max(apart) == 0
    few = [f"only{i} two{i}" for i in range(50)]
    assert len({imatch.hexed(make(t)) for t in few}) == 50
    assert max(imatch.likeness(make(a), make(b)) for a, b in zip(few, few[1:])) == 0
