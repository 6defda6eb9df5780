import hashlib
import random

import numpy as np
import public_tokenizers
from cases import TABLES, nothing, tricky, tricky_rows
from tokenizers import Tokenizer

import __spark_entry__ as entry
from crossfield.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(texts):
    lib = library()
    ids = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [(i, lib.decode(i, skip_special_tokens=False)) for i in ids]


def test_encoding_equals_the_library_on_awkward_text():
    r = random.Random(1)
    letters = "aAbBßİΣσςéÉé \t\n\x0b\x1c\x1f\x85\xa0 ​'’sStT0123٣Ⅷ½中文🙂#$<|>endoftextǅﬁ가힣౜\U00010d5c"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["a<|endoftext|>B  <|startoftext|>it's I'LL", "", None, "a" * 5000, "ab" * 3000, "<|endoftext|>" * 3, "\0 \0"]
    vocab = bpe.Vocabulary(PATH)
    got = [np.frombuffer(p, "<u4").tolist() for p in bpe.encode_texts(texts, vocab)]
    want = expected(texts)
    assert got == [ids for ids, _ in want]
    assert [bpe.decode_ids(np.array(i, "<u4").tobytes(), vocab) for i in got] == [text for _, text in want]


def test_small_memory_of_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 70)
    texts = [t for _, t, *_ in tricky_rows()]
    vocab = bpe.Vocabulary(PATH)
    for _ in range(2):
        got = [np.frombuffer(p, "<u4").tolist() for t in texts for p in bpe.encode_texts([t], vocab)]
        assert got == [ids for ids, _ in expected(texts)]


def test_operator_on_awkward_rows(spark):
    df = tricky(spark)
    out = bpe.decode(bpe.encode(df)).withColumn("ids", bpe.unpack_ids("ids_le"))
    assert set(df.columns) < set(out.columns)
    rows = out.collect()
    assert len(rows) == df.count()
    for row, (ids, text) in zip(rows, expected([r["text"] for r in rows])):
        assert (row["ids"], row["n_tokens"], row["decoded"]) == (ids, len(ids), text)
    assert bpe.encode(nothing(spark), decoded=True).count() == 0


def test_query_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, expected(docs.values())))
    for row in entry.queries()["op1_bpe"](spark, TABLES).collect():
        ids, text = want[row["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
