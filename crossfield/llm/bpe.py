"""Byte-pair encoding and decoding with a public word-level vocabulary.

Encoding works on the distinct words of a batch, not on texts. All words stand in one flat
list of symbols, linked to their neighbours inside the word. An index maps each pair that
has a merge rule to all its positions. The active ranks are taken in ascending order; each
applies its rule at all listed positions, left to right, and the merged symbol's new pairs
enter the index under their own ranks. If a merge activates a lower rank, the rest of the
list waits, as it would if each word were merged alone. Pieces already met are looked up.

Before that a text is cut at the special tokens and white space, its pieces are normalised
(NFC, lower case letter by letter) and split into words; the bytes of a word are written
as the vocabulary's letters and its last symbol carries the word-end mark.

``encode`` adds the ids as little-endian unsigned 32-bit integers in one binary value and
their number; ``unpack_ids`` gives them as an array; ``decode`` joins the tokens of packed
ids by single spaces, as the library does for a vocabulary without a decoder.

Defined results: null and empty texts have no tokens and decode to the empty text; ids
outside the vocabulary are left out in decoding; null ids decode to the empty text. Added
columns replace input columns of the same name; all others pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfield.llm.common import without
from crossfield.llm.registry import documents, register

WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Controls that Python's split takes for white space and the vocabulary's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# A pair of ids as one number; symbols between words and of merged-away places.
PAIR, EDGE, GONE = 1 << 20, -1, -2
# Pieces and words remembered per worker; beyond it the memory starts anew.
CACHE_PIECES, CACHE_WORDS = 250_000, 250_000
# Texts are handled in groups of about so many characters.
GROUP_CHARS = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else 256 and up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merge rules by rank and by pair of ids, token strings, and the pieces met so far.

    A piece is a stretch between white space or a special token; its packed ids are remembered.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, model = spec["model"]["vocab"], spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        tokens = {i: token for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens |= {i: token for token, i in self.special.items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rules = [(ids[x], ids[y], ids[x + y]) for x, y in pairs]
        self.ranks = {x * PAIR + y: rank for rank, (x, y, _) in reversed(list(enumerate(self.rules)))}
        # Symbols of a byte inside a word and at its end; the byte 255 stands between words.
        self.first = np.array([ids.get(c, GONE) for c in byte_letters()[:255]] + [EDGE])
        self.last = np.array([ids.get(c + self.end, GONE) for c in byte_letters()[:255]] + [EDGE])
        self.find = regex.compile(WORD_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.known: dict[str, bytes] = {}
        self.coded: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The text between white space; special tokens stand as pieces after a space."""
        if any(s in text for s in self.special):
            out = []
            for k, part in enumerate(self.cut(text)):
                out += [" " + part] if k % 2 else self.pieces(part)
            return out
        if any(c in text for c in SEPARATORS):
            return [p for p in SPACES.split(text) if p]
        return text.split()

    def words(self, piece: str) -> list[str]:
        """The words of a piece, after normalising it."""
        if not piece.isascii():
            if any(unicodedata.category(c) == "Cn" for c in piece):
                return self.newer_words(piece)
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return self.find(piece.lower())

    def newer_words(self, piece: str) -> list[str]:
        """Pieces with letters newer than Python's character tables: the library's tables know them."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        steps = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        cut = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True)
        return [w for w, _ in cut.pre_tokenize_str(steps.normalize_str(piece))]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before: their words not met before go through the merges at once."""
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self.known = {}
        plain = []
        for piece in pieces:
            if piece[0] == " ":
                self.known[piece] = self.special[piece[1:]].to_bytes(4, "little")
            else:
                plain.append(piece)
        split = [self.words(p) for p in plain]
        wanted = dict.fromkeys(w for words in split for w in words)
        distinct = [w for w in wanted if w not in self.coded]
        if len(self.coded) + len(distinct) > CACHE_WORDS:
            self.coded, distinct = {}, list(wanted)
        self.coded |= zip(distinct, merge_words(distinct, self))
        coded = self.coded
        for piece, words in zip(plain, split):
            self.known[piece] = b"".join([coded[w] for w in words])


def merge_words(words: list[str], vocab: Vocabulary) -> list[bytes]:
    """Packed ids of distinct words, through one index from ranks to the positions of their pair."""
    if not words:
        return []
    data = np.frombuffer(b"\xff".join([w.encode("utf-8") for w in words]) + b"\xff", np.uint8)
    ends = np.append(data[1:] == 255, False)
    flat = np.where(ends, vocab.last[data], vocab.first[data])
    flat = flat[flat != GONE]
    # The index of all pairs at the start: positions sorted by rank.
    ranks, rules = vocab.ranks, vocab.rules
    pairs, which = np.unique(np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] * PAIR + flat[1:], -1), return_inverse=True)
    rank_at = np.array([ranks.get(p, -1) for p in pairs.tolist()], np.int64)[which] if len(pairs) else np.zeros(0, np.int64)
    order = np.argsort(rank_at, kind="stable")
    order = order[np.searchsorted(rank_at[order], 0):]
    begun, at = np.unique(rank_at[order], return_index=True)
    index = dict(zip(begun.tolist(), [part.tolist() for part in np.split(order, at[1:])])) if len(order) else {}
    active = begun.tolist()
    symbol = flat.tolist()
    after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
    push, pop, rank_of = heapq.heappush, heapq.heappop, ranks.get
    while active:
        rank = pop(active)
        places = index.pop(rank, None)
        if places is None:
            continue
        left, right, merged = rules[rank]
        places.sort()
        for done, place in enumerate(places):
            then = after[place]
            if symbol[place] != left or symbol[then] != right:
                continue
            symbol[place], symbol[then] = merged, GONE
            far, prior = after[then], before[place]
            after[place] = far
            before[far] = place
            # The two new pairs enter the index; words end at EDGE, which has no pairs.
            right_rank, left_rank = rank_of(merged * PAIR + symbol[far]), rank_of(symbol[prior] * PAIR + merged)
            least = rank
            if right_rank is not None:
                if right_rank in index:
                    index[right_rank].append(place)
                else:
                    index[right_rank] = [place]
                    push(active, right_rank)
                least = right_rank if right_rank < least else least
            if left_rank is not None:
                if left_rank in index:
                    index[left_rank].append(prior)
                else:
                    index[left_rank] = [prior]
                    push(active, left_rank)
                least = left_rank if left_rank < least else least
            if least < rank and done + 1 < len(places):
                # A lower rank became active: the rest of this list waits for it.
                index[rank] = places[done + 1:] + index.get(rank, [])
                push(active, rank)
                break
    left = np.array(symbol)
    left = left[left != GONE]
    edges = np.flatnonzero(left == EDGE)
    packed = left.astype("<u4").tobytes()
    starts = np.concatenate([[0], edges[:-1] + 1])
    return [packed[4 * a:4 * z] for a, z in zip(starts.tolist(), edges.tolist())]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> list[bytes]:
    """Packed ids of each text; pieces not met before are learned for the whole list at once."""
    split = [vocab.pieces(t) if t else [] for t in texts]
    met = set()
    met.update(*split)
    new = met - vocab.known.keys()
    if new:
        kept = len(vocab.known) + len(new) <= CACHE_PIECES
        vocab.learn(new if kept else met)
    known = vocab.known
    return [b"".join([known[p] for p in pieces]) for pieces in split]


def decode_ids(packed: bytes | None, vocab: Vocabulary) -> str:
    tokens = vocab.tokens
    ids = np.frombuffer(packed or b"", "<u4")
    if len(ids) and ids.max() >= len(tokens):
        ids = ids[ids < len(tokens)]
    found = [tokens[i] for i in ids.tolist()]
    return " ".join(found if None not in found else [t for t in found if t is not None])


def groups_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with about ``GROUP_CHARS`` characters."""
    start = chars = 0
    for k, text in enumerate(texts):
        chars += len(text or "")
        if chars >= GROUP_CHARS:
            yield start, k + 1
            start, chars = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _schema(df: DataFrame, *added: tuple[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    kept = without(df, *[name for name, _ in added])
    return kept, T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in added]])


def _carry(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(df: DataFrame, text: str = "text", path: str | None = None, drop_text: bool = False, decoded: bool = False) -> DataFrame:
    """``df`` with ``ids_le`` (packed ids) and ``n_tokens``; the text goes if ``drop_text``.

    ``decoded`` also decodes the ids again, in the same pass over the table.
    """
    path = path or default_vocabulary()
    added = [("ids_le", T.BinaryType()), ("n_tokens", T.LongType()), *([("decoded", T.StringType())] if decoded else [])]
    kept, schema = _schema(df.withColumn("_llm_text", F.col(text)), *added)
    if drop_text:
        kept = without(kept, text)
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != "_llm_text"], *schema.fields[-len(added):]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_llm_text")).to_pylist()
            rest = batch.drop_columns(["_llm_text"])
            for a, z in groups_of(texts):
                packed = encode_texts(texts[a:z], vocab)
                columns = {"ids_le": pa.array(packed, pa.binary()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}
                if decoded:
                    columns["decoded"] = pa.array([decode_ids(p, vocab) for p in packed], pa.string())
                yield _carry(rest.slice(a, z - a), **columns)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids_le", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the packed ids, special tokens included."""
    path = path or default_vocabulary()
    kept, schema = _schema(df.withColumn("_llm_ids", F.col(ids)), ("decoded", T.StringType()))
    schema = T.StructType([f for f in schema.fields if f.name != "_llm_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index("_llm_ids")).to_pylist()
            texts = [decode_ids(p, vocab) for p in packed]
            yield _carry(batch.drop_columns(["_llm_ids"]), decoded=pa.array(texts, pa.string()))

    return kept.mapInArrow(run, schema)


def unpack_ids(packed: str | Column) -> Column:
    """Packed ids as an array of longs, JVM-side."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    def one(i: Column) -> Column:
        part = [F.conv(F.hex(F.substring(packed, i * 4 + k, 1)), 16, 10).cast("long") for k in (1, 2, 3, 4)]
        return part[0] + part[1] * 256 + part[2] * 65536 + part[3] * 16777216
    count = (F.octet_length(packed) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))


@register("op1_bpe")
def op1_bpe(spark, sf_dir):
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), drop_text=True, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents with packed token ids, their number, and the decoded text's digest."""
    coded = encode(docs, decoded=True)
    return coded.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")
