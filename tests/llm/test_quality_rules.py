from collections import Counter, defaultdict

from cases import TABLES, nothing, prose, tricky, tricky_rows, words
from oracle_check import compare, connect


import __spark_entry__ as entry
from crossfield.llm import quality_rules as op


def repeated(text):
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(8)})


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op6_quality_rules"](spark, TABLES), connect(TABLES), entry.oracle_sql()["op6_quality_rules"]) is None


def test_measures_on_awkward_rows(spark):
    df = tricky(spark)
    got = op.assess(df).collect()
    assert len(got) == df.count()
    want = Counter()
    for d, t, *_ in tricky_rows():
        t = t or ""
        lines = [line for line in t.split("\n") if words(line)]
        want[d, len(words(t)), sum(map(len, words(t))), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(t)] += 1
    assert Counter((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in got) == want
    assert all(not r["kept"] for r in got if r["n_words"] < 20)
    assert op.clean(nothing(spark)).count() == 0


def test_boilerplate_goes_depleted_documents_go_and_the_first_holder_stays(spark):
    footer = "All Rights  reserved 2024 by the owner of this page and its contents"
    rows = [(i, prose(i, 60) + "\n" + footer.replace("2024", str(1990 + i)), "h") for i in range(10)]
    rows += [(100 + i, "\n".join(prose(500, 60).split("\n")) + f"\nnumber x{i}a", "h") for i in range(10)]
    rows += [(200 + i, prose(600, 60), "h") for i in range(10)]            # exact copies are one document
    rows += [(300, prose(700, 60) + "\n" + footer, None)]                  # another host
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in op.clean(df, op.QualityRules(max_documents=5)).collect()}
    text = {d: t for d, t, _ in rows}
    assert got[0] == text[0] and got[300] == text[300]
    assert all(got[i] == text[i].rsplit("\n", 1)[0] for i in range(1, 10))
    assert got[100] == text[100] and not any(100 < d < 200 for d in got)
    assert all(got[200 + i] == text[200 + i] for i in range(10))


def test_clean_keeps_all_columns(spark):
    df = tricky(spark)
    out = op.clean(df)
    assert out.columns == df.columns
    held = defaultdict(int)
    for r in out.collect():
        held[r["doc_id"]] += 1
        assert r["size"] == "extra"
    assert held[0] == held[1] == 1 and 3 not in held and 5 not in held and 14 not in held


def test_boilerplate_of_the_stage_depends_on_the_share_not_on_the_size(spark):
    def left(n):
        """Shares of the frequent and of the rarer line that stay, in a host of n texts."""
        often, rare = "this line stands in a fifth of all texts", "this line stands in a fiftieth of them"
        rows = [(i, prose(9000 + i, 36) + (f"\n{often}" if i % 5 == 0 else "") + (f"\n{rare}" if i % 50 == 1 else ""), "h") for i in range(n)]
        texts = [r["text"] for r in op.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()]
        assert len(texts) == n
        return sum(often in t for t in texts), sum(rare in t for t in texts) / n

    assert left(300) == (1, 0.02) and left(6000) == (1, 0.02)


def test_the_query_removes_lines_and_its_verdict_is_not_only_the_base_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    found = op.assess(docs, op.BY_SHARE)
    row = found.selectExpr("count_if(boilerplate IS NOT NULL) AS cut", "count_if(NOT kept AND NOT base_failed) AS depleted").first()
    assert row.cut > 0
    print(row)
