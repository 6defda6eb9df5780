"""Secret scan with one combined deterministic automaton.

All rules are compiled into one minimal search automaton; every text is read once, byte by
byte, for all rules. (The long hexadecimal run is searched with its least length, as short
ones are in every text; the other rules have rare heads and are searched without, since
counters of several rules would multiply the states.) Only for the rules that it reports in
a text are spans taken, by the rule's own anchored automaton: leftmost, longest, not
overlapping within a rule, and a match that is too short is dropped without looking for
another inside it.

Base rules: ``assign`` (a keyword, an assignment, a value), ``access`` (an access key id),
``hex`` (a long hexadecimal run). The method adds ``private_key``, ``code_token``,
``chat_token``, ``map_key``, ``web_token``: fixed published prefixes of key formats.

Spans are (kind, start, end) in code points, end exclusive, by start and then by the order
of the rules. Defined results: null and empty texts have no spans; equal rows give equal
results; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfield.llm.automaton import Automaton, chars, compile_patterns, either, many, maybe, search, seq, spans, text, times
from crossfield.llm.common import text_of
from crossfield.llm.registry import documents, register


@dataclass(frozen=True)
class Rule:
    kind: str
    head: tuple        # what stands before the counted part
    body: tuple        # one byte of the counted part
    least: int         # the counted part's least length to pass
    counted_from: int  # bytes of the head that count as well
    whole: int = 1     # least length of the counted part for a match at all
    screen: int = 1    # least length of the counted part that the search asks for


WORDY = chars("A-Za-z0-9_-")
KEYWORD = either(*[text(w, fold=True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])
QUOTE = maybe(chars("\"'"))
BLANKS = many(chars(" "))
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", seq(KEYWORD, QUOTE, BLANKS, chars(":="), BLANKS, QUOTE), chars("A-Za-z0-9+/_.=-"), 8, 0),
    Rule("access", text("AKIA"), chars("A-Z0-9"), 16, 4),
    Rule("hex", seq(), chars("0-9a-f"), 32, 0, screen=32),
    Rule("private_key", seq(text("-----BEGIN "), many(chars("A-Z ")), text("PRIVATE KEY-----")), chars("A-Za-z0-9+/=\r\n"), 32, 0, 0),
    Rule("code_token", seq(text("gh"), chars("pousr"), text("_")), chars("A-Za-z0-9"), 36, 0),
    Rule("chat_token", seq(text("xox"), chars("abprs"), text("-")), WORDY, 20, 0),
    Rule("map_key", text("AIza"), WORDY, 35, 0),
    Rule("web_token", seq(text("eyJ"), many(WORDY, 1), text(".eyJ"), many(WORDY, 1), text(".")), WORDY, 16, 0),
)
KINDS = tuple(r.kind for r in RULES)

_COMPILED: dict[str, tuple[Automaton, list[Automaton], list[Automaton]]] = {}


def compiled() -> tuple[Automaton, list[Automaton], list[Automaton]]:
    """The search automaton of all rules; per rule the automata of matches and of passing ones."""
    if not _COMPILED:
        passing = [seq(r.head, many(r.body, max(r.least - r.counted_from, 1))) for r in RULES]
        _COMPILED["all"] = (
            compile_patterns([seq(r.head, times(r.body, r.screen)) for r in RULES], anywhere=True),
            [compile_patterns([seq(r.head, many(r.body, r.whole))], anywhere=False) for r in RULES],
            [compile_patterns([p], anywhere=False) for p in passing])
    return _COMPILED["all"]


def find(data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in bytes, in order."""
    combined, matching, passing = compiled()
    found = search(combined, data)
    out = []
    for k in range(len(RULES)):
        if found >> k & 1:
            for a, b in spans(matching[k], data):
                if spans(passing[k], data[a:b]) == [(0, b - a)]:
                    out.append((a, k, b))
    return sorted(out)


def in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found or data.isascii():
        return found
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in found]


def scan(df: DataFrame, doc_id: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, found): an array of (kind, start, end) per text."""
    source = df.select(F.col(doc_id).alias("doc_id"), text_of(text_column).cast("binary").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                data = value.as_py()
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in in_code_points(data, find(data))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, span)], names=["doc_id", "found"])

    kind = df.schema[doc_id].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, found array<struct<kind string, start long, end long>>")


def number_of(found, kind: str):
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def listed(found):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op10_secrets")
def op10_secrets(spark, sf_dir):
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", *[number_of(found, k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(found).alias("spans"))
