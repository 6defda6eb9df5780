import hashlib

from cases import nothing, prose, tricky, tricky_rows, words

from crossfield.llm import line_dedup


def chunks(text):
    lines = (text or "").split("\n")
    values = [int(hashlib.md5(line.encode()).hexdigest()[:7], 16) for line in lines]
    out, start = [], 0
    for i in range(1, len(lines)):
        past = [values[i - k] if i >= k else 0 for k in (1, 2, 3)]
        if (past[0] + 31 * past[1] + 961 * past[2]) % 4 == 0:
            out.append(lines[start:i])
            start = i
    return [*out, lines[start:]]


def brute(rows):
    """Text left of each (id, text)."""
    seen, left = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        kept, gone = [], False
        for i, c in enumerate(chunks(t)):
            key = "\n".join(c)
            if sum(bool(words(line)) for line in c) >= 2 and seen.setdefault(key, (d, t, i)) != (d, t, i):
                gone = True
            else:
                kept += c
        left[d, t] = "\n".join(kept) if gone else t
    return left


def test_repeated_chunks_go_and_nothing_else(spark):
    df = tricky(spark)
    rows = [(r[0], r[1]) for r in tricky_rows()]
    want = brute(rows)
    assert any(want[r] != r[1] for r in rows)
    found = line_dedup.dedup(df, n_chars="n_chars")
    assert found.select("d.*").columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in found.select("d.*").collect())
    assert got == sorted((d or -1, want[d, t] or "") for d, t in rows)
    assert {r["size"] for r in found.select("d.*").collect()} == {"extra"}


def test_chunk_ends_move_with_inserted_lines():
    lines = [f"line {i}" for i in range(200)]
    before = {tuple(c) for c in chunks("\n".join(lines))}
    after = {tuple(c) for c in chunks("\n".join(["new", *lines]))}
    assert len(before - after) <= 2


def test_empty_table(spark):
    assert line_dedup.dedup(nothing(spark)).count() == 0
    assert line_dedup.stage(spark, nothing(spark), "").columns == nothing(spark).columns


def test_stage_drops_documents_left_without_words(spark):
    text = "\n".join(f"line {i} of it" for i in range(60))
    whole = [c for c in chunks(text) if len(c) >= 2]
    body = "\n".join(line for c in whole for line in c)
    df = spark.createDataFrame([(1, body), (2, body), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, df, "").collect()}
    assert got[1] == body and got[3] == ""


def test_stage_removes_passages_in_other_surroundings(spark):
    rows, want = [], {}
    for k in range(42):
        n = 2 + k % 7
        passage = prose(7000 + k, 12 * n).split("\n")
        around = [prose(8000 + 10 * k + j, 12 * (1 + (k + j) % 5)).split("\n") for j in range(4)]
        if k % 3 == 0:
            passage.insert(1, "")
        rows += [(2 * k, "\n".join(around[0] + passage + around[1])), (2 * k + 1, "\n".join(around[2] + passage + around[3]))]
        want |= {2 * k: rows[-2][1], 2 * k + 1: "\n".join(around[2] + around[3])}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, df, "").collect()} == want


def test_passages_repeated_within_a_text_keep_their_first_place(spark):
    rows = [(0, "a a\na a\na a\na a"), (1, "b\nc\nb\nc\nb\nc\nd"), (2, "e\na a\na a\nf\nc\nd"), (3, "e\nc\nx"), (None, "e\nc\ny"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.repeated_pairs(df).collect()
    assert {r["id"]: sorted(r["again"]) for r in found} == {0: [1, 2], 1: [2, 3, 4], 2: [1, 4], None: [0]}
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup(df.filter("doc_id IN (0, 2, 3) OR doc_id IS NULL"), passages=True).select("d.*").collect()}
    assert got >= {(2, "e\nf\nc\nd"), (3, "e\nc\nx"), (None, None)} and (None, "y") in got
