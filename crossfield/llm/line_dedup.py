"""Line dedup by content-defined chunks.

A line's value is the first 28 bits of its MD5. A rolling hash over the last three line
values ends a chunk wherever it is divisible by ``DIVISOR``, so chunk ends depend on nearby
lines only and move along with inserted or deleted lines. A chunk with at least two lines
that hold a word is a multi-line chunk. Chunks are dealt out by their MD5 and their texts are
compared byte for byte; every occurrence but the first (smallest id, then place in the
document) is removed.

Chunk ends lose most short passages: a passage in other surroundings rarely holds a whole
chunk. ``passages`` adds the finest overlapping chunks, every two worded lines that follow each
other (with the blank lines between), compared by SHA-256. Repeated runs of two or more worded lines, whatever is
around them, are just unions of such pairs, so each is removed from end to end. Identical
texts count as one text there: a copy loses what its first one loses, and the chunks above
besides. A line of a pair's first occurrence stays where the next pair repeats it at once.

A chunk that is everywhere reaches the comparison as one row for each task that met it: the
first place is a minimum, combined before the shuffle. Repeats are the places that are no
chunk's first, found under the document's id and text digest, which no chunk makes hot.

Defined results: null text stays null and has no chunks; blank lines alone are never
removed; null ids come last when the first occurrence is chosen; rows that agree in id and
text share their result; an empty table gives an empty result. All columns of the input
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.llm.common import bind, text_of
from crossfield.llm.registry import documents, register

BASE = 31
DIVISOR = 4
MIN_LINES = 2


def line_value(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks_of(text: Column) -> Column:
    """Chunks of a text in order: (lines, words) with the number of lines that hold a word."""
    def cut(lines: Column) -> Column:
        def starts(values: Column) -> Column:
            def rolled(i: Column) -> Column:
                past = [F.coalesce(F.get(values, i - k), F.lit(0)) for k in (1, 2, 3)]
                return (past[0] + past[1] * BASE + past[2] * BASE * BASE) % DIVISOR
            return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (rolled(i) == 0))

        def chunks(at: Column) -> Column:
            return F.transform(at, lambda a, k: F.slice(lines, a + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - a))

        return bind(bind(F.transform(lines, line_value), starts), chunks)

    return bind(F.split(text, "\n"), cut)


def worded(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))


def worded_places(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def pair_of(lines: Column, at: Column, k: Column) -> Column:
    """Lines from the k-th worded line to the next one."""
    return F.slice(lines, F.get(at, k) + 1, F.get(at, k + 1) - F.get(at, k) + 1)


def pairs_of(text: Column) -> Column:
    """Every two worded lines of a text that follow each other, in order, as texts."""
    def pairs(lines: Column) -> Column:
        return bind(worded_places(lines), lambda at: F.transform(
            F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda _, k: F.array_join(pair_of(lines, at, k), "\n")))

    return bind(F.split(text, "\n"), pairs)


def pair_lines(lines: Column, again: Column) -> Column:
    """The numbers of the lines that repeated pairs (their numbers) remove."""
    def gone(at: Column) -> Column:
        def reach(k: Column) -> Column:
            # The pair before is this pair's first occurrence and shares a line with it.
            own = ~F.array_contains(again, k - 1) & (pair_of(lines, at, k) == pair_of(lines, at, k - 1))
            return F.sequence(F.get(at, k) + F.when((k > 0) & own, 1).otherwise(0), F.get(at, k + 1))
        return F.array_distinct(F.flatten(F.transform(again, reach)))

    return bind(worded_places(lines), gone)


def repeated_pairs(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, node, again): per document the numbers of the pairs that an earlier place holds."""
    keyed = df.select(F.col(doc_id).alias("id"), F.md5(text_of(text)).alias("node"), text_of(text).alias("text"))
    # Each line is in two pairs: their texts take 5.1 x the input on disk, so SHA-256 stands for them.
    pieces = keyed.select("id", F.unhex("node").alias("node"), F.posexplode(pairs_of(F.col("text"))).alias("k", "pair")).select(
        "id", "node", "k", F.unhex(F.sha2(F.col("pair").cast("binary"), 256)).alias("h"))
    place = F.struct(F.col("id").isNull(), "id", "node", "k")
    firsts = pieces.select(place.alias("p"), "h").groupBy("h").agg(F.min("p").alias("p")).select(
        F.col("p.node").alias("f_node"), F.col("p.k").alias("f_k"))
    again = pieces.select("node", "k").distinct().join(firsts.hint("merge"), (F.col("node") == F.col("f_node")) & (F.col("k") == F.col("f_k")), "left_anti")
    found = again.groupBy("node").agg(F.collect_set("k").alias("again")).select(F.lower(F.hex("node")).alias("a_node"), "again")
    rows = keyed.select("id", "node").distinct()
    return rows.join(found.hint("merge"), F.col("node") == F.col("a_node")).select("id", "node", "again")


def removals(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, node, cut): per document the numbers of the chunks to remove."""
    keyed = df.select(F.col(doc_id).alias("id"), F.md5(text_of(text)).alias("node"), text_of(text).alias("text"))
    pieces = keyed.select("id", "node", F.posexplode(chunks_of(F.col("text"))).alias("i", "lines")).filter(worded(F.col("lines")) >= MIN_LINES)
    place = F.struct(F.col("id").isNull(), "id", "node", "i")
    firsts = pieces.select(place.alias("p"), F.array_join("lines", "\n").alias("chunk")).withColumn("h", F.unhex(F.md5("chunk"))).groupBy(
        "h", "chunk").agg(F.min("p").alias("p")).select(F.col("p.id").alias("f_id"), F.col("p.node").alias("f_node"), F.col("p.i").alias("f_i"))
    # What is not the first occurrence of any chunk occurs again. Sort-merge at every size:
    # the places and the lists of cuts grow with the table.
    again = pieces.select("id", "node", "i").join(
        firsts.hint("merge"), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("node") == F.col("f_node")) & (F.col("i") == F.col("f_i")), "left_anti")
    return again.groupBy("id", "node").agg(F.collect_set("i").alias("cut"))


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = None,
          passages: bool = False) -> DataFrame:
    """``d`` (the row, its text and ``n_chars`` as they are afterwards) with n_lines and n_removed lines."""
    cuts = removals(df, text, doc_id).withColumn("again", F.lit(None).cast("array<int>"))
    if passages:
        both = cuts.union(repeated_pairs(df, text, doc_id).select("id", "node", F.lit(None).cast("array<int>"), "again"))
        cuts = both.groupBy("id", "node").agg(*[F.coalesce(F.first(c, ignorenulls=True), F.array().cast("array<int>")).alias(c) for c in ("cut", "again")])
    cuts = cuts.select(F.col("id").alias("c_id"), F.col("node").alias("c_node"), "cut", "again")
    packed = df.select(F.struct("*").alias("d"), F.col(doc_id).alias("id"), F.md5(text_of(text)).alias("node"))
    joined = packed.join(cuts.hint("merge"), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("node") == F.col("c_node")), "left")
    old = F.col(f"d.`{text}`")
    stays = F.flatten(F.filter(chunks_of(text_of(old)), lambda c, i: ~F.array_contains(F.col("cut"), i)))
    if passages:
        marks = F.flatten(F.transform(chunks_of(text_of(old)), lambda c, i: F.transform(c, lambda _: F.array_contains(F.col("cut"), i))))
        lines = F.split(text_of(old), "\n")
        stays = bind(F.struct(lines.alias("lines"), marks.alias("marks"), pair_lines(lines, F.col("again")).alias("gone")), lambda t: F.filter(
            t["lines"], lambda _, i: ~F.get(t["marks"], i) & ~F.array_contains(t["gone"], i)))
    left = joined.withColumn("stays", F.when(F.col("cut").isNotNull(), stays))
    new = F.when(F.col("cut").isNull(), old).otherwise(F.array_join("stays", "\n"))
    n_lines = F.size(F.split(text_of(old), "\n"))
    fresh = {text: new}
    if n_chars and n_chars in df.columns:
        fresh[n_chars] = F.when(F.col("cut").isNull(), F.col(f"d.`{n_chars}`")).otherwise(F.length(new).cast("long"))
    row = F.struct(*[fresh.get(c, F.col(f"d.`{c}`")).alias(c) for c in df.columns])
    return left.select(row.alias("d"), n_lines.cast("long").alias("n_lines"),
                       F.when(F.col("cut").isNull(), F.lit(0)).otherwise(n_lines - F.size("stays")).cast("long").alias("n_removed"))


@register("op2_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM d),
v AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS v FROM l),
b AS (SELECT *, CASE WHEN i > 0 AND (lag(v, 1, 0) OVER w + 31 * lag(v, 2, 0) OVER w + 961 * lag(v, 3, 0) OVER w) % 4 = 0 THEN 1 ELSE 0 END AS cut
      FROM v WINDOW w AS (PARTITION BY row ORDER BY i)),
c AS (SELECT *, sum(cut) OVER (PARTITION BY row ORDER BY i)::BIGINT AS k FROM b),
g AS (SELECT row, doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk,
             count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS worded FROM c GROUP BY row, doc_id, k),
f AS (SELECT *, worded >= 2 AND row_number() OVER (PARTITION BY worded >= 2, chunk ORDER BY doc_id, k) > 1 AS gone FROM g)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY row, doc_id
""")
def op2_line_dedup(spark, sf_dir):
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("d.doc_id", "n_lines", "n_removed", F.sha2(text_of(F.col("d.text")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: repeated chunks and passages go; documents of which no word is left go with them."""
    found = dedup(docs, n_chars="n_chars", passages=True)
    return found.filter((F.col("n_removed") == 0) | F.col("d.text").rlike(r"[^\x20\x09-\x0D]")).select("d.*")
