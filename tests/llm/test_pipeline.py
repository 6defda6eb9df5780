import hashlib

import pytest
from cases import nothing, prose, tricky
from test_line_dedup import chunks

import corpus_pipeline
from crossfield.llm import bpe


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    base = prose(40, 300)
    parts = base.split()
    near = [" ".join(parts[:30 * k] + [f"edit{k}"] + parts[30 * k + 1:]) for k in range(1, 6)]
    rows = [(0, base, "en", "s0", len(base)), (1, "too short", "en", "s0", 9)]
    rows += [(10 + k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(near)]
    rows += [(50 + k, base, "de", "s1", len(base)) for k in range(3)]
    rows += [(100 + k, t := prose(1000 + k, 80), "en", f"s{k % 4}", len(t)) for k in range(60)]
    rows += [(500, "again and again the line " * 30, "en", "s2", 1), (501, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]


def test_run(spark, corpus):
    folder, texts = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in rows]
    assert not {1, 500, 501} & set(ids)                      # rejected by the rules
    assert len({0, *range(10, 15)} & set(ids)) <= 1          # one of the near copies at most (the mix may leave it out)
    clean = [r for r in rows if 100 <= r["doc_id"] < 160]
    assert all(r["text"] == texts[r["doc_id"]] for r in clean) and len({r["doc_id"] for r in clean}) > 20
    assert all(ids.count(d) <= 3 for d in ids)
    vocab = bpe.vocabulary(bpe.default_vocabulary())
    for r in rows:
        packed = bpe.encode_texts([r["text"]], vocab)[0]
        assert bytes(r["ids_le"]) == packed
        assert r["decoded_sha256"] == hashlib.sha256(bpe.decode_ids(packed, vocab).encode()).hexdigest()


def test_stages_before_the_mix(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ruled = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert {r["doc_id"] for r in ruled.collect()} == set(texts) - {1, 500, 501}
    lined = corpus_pipeline.STAGES[1][1](spark, ruled, folder)
    left = {r["doc_id"]: r["text"] for r in lined.collect()}
    single = [c for c in chunks(texts[0]) if len(c) < 2]
    for d in (50, 51, 52):
        assert left.get(d, "") == "\n".join(line for c in single for line in c)
    once = corpus_pipeline.STAGES[2][1](spark, ruled, folder)
    assert {r["doc_id"] for r in once.collect()} == {0, *range(100, 160)}


def test_every_stage_on_awkward_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        for df in (tricky(spark), nothing(spark)):
            out = stage(spark, df, "")
            assert out.columns[:len(df.columns)] == df.columns
            assert out.count() >= 0
