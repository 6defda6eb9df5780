"""Quality rules: per-document measures and cross-document line frequency (DataFrame functions only).

Lines are normalised (trimmed, lower case, white space joined, digit runs as 0) and hashed.
For every host and line the *distinct documents* that hold it are counted; identical texts
count as one document. A line held by more than ``max_documents`` documents of a host, and by
more than ``max_share`` of its distinct texts if that is given, is boilerplate there, except in
the first document that holds it (smallest id), which keeps it.
A document that keeps less than ``min_left`` of its line characters is depleted and goes.

Lines are counted in two steps, per (host, line, text) and then per (host, line), both
combined before the shuffle, so a line or a text that is everywhere reaches a task as one
row for each task that met it.

Defined results: null text is an empty text (no words, fails the word minimum); a null host
is a host of its own; blank lines are never counted or removed; rows with equal id, host and
text get equal verdicts; an empty table gives an empty result. Input columns named like an
added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.llm.common import bind, materialize, text_of, without, words_of
from crossfield.llm.registry import documents, register

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_documents: int = 100
    min_left: float = 0.5
    max_share: float | None = None


# With a share the verdict depends on how frequent a line is in its host, not on the host's size;
# the number is only a floor. The query op6 and the pipeline stage use these rules.
BY_SHARE = QualityRules(max_documents=10, max_share=0.05)


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(places: Column) -> Column:
        ends = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(ends, F.lit(0), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        twins = F.filter(ordered, lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(twins, lambda e: e["i"]))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = bind(bind(ordered, places), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0))

    return F.when(F.size(words) > WINDOW, bind(windows, count)).otherwise(F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    plain = F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    return F.regexp_replace(F.trim(plain), "[0-9]+", "0")


def measures(text: Column) -> Column:
    """A struct of the per-document measures and the normalised lines as (hash, characters)."""
    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"))

    def lines(found: Column) -> Column:
        return F.struct(
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            F.transform(F.transform(found, normalised), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))).alias("lines"))

    # One let-expression, so that the optimizer cannot spread it over its readers.
    return bind(text, lambda t: F.struct(
        bind(words_of(t), of).alias("w"), bind(lines_of(t), lines).alias("l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.xxhash64(t, F.length(t)).alias("h")))


def assess(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source",
           doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, host, text hash, measures, base_failed, boilerplate line hashes, kept), one row per document."""
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), measures(text_of(text)).alias("m"))
    base = materialize(base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", F.col("m.h").alias("h"), F.col("m.l.lines").alias("lines"),
        *[F.col(f"m.{'l.' if c == 'n_dup_lines' else '' if c == 'n_symbols' else 'w.'}{c}").alias(c) for c in MEASURES]), "quality-base")
    occurrences = base.select("row", "doc_id", "host", "h", F.explode("lines").alias("line")).select(
        "row", "doc_id", "host", "h", F.col("line.h").alias("line"), F.col("line.n").alias("n"))
    holders = occurrences.groupBy("host", "line", "h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    frequent = (
        holders.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("first", "h"))["h"].alias("keeper"))
        .filter(F.col("held") > rules.max_documents)
    )
    if rules.max_share is not None:
        texts = base.select("host", "h").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts")).withColumnRenamed("host", "t_host")
        frequent = frequent.join(texts, F.col("host").eqNullSafe(F.col("t_host"))).filter(F.col("held") > rules.max_share * F.col("texts"))
    frequent = materialize(
        frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "keeper"), "quality-frequent")
    removed = (
        occurrences.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")) & (F.col("h") != F.col("keeper")))
        .groupBy("row").agg(F.sum("n").alias("gone"), F.collect_set("line").alias("boilerplate"))
    )
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    depleted = F.coalesce(total - F.col("gone") < rules.min_left * total, F.lit(False))
    return (
        base.join(removed, "row", "left").withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select("doc_id", "host", "h", *MEASURES, "base_failed", "boilerplate", "kept")
    )


@register("op6_quality_rules", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT row, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT row, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM
        (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT row, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM rep GROUP BY row),
raw AS (SELECT row, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT row, doc_id, source, text, line, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]{2,}|[\x09-\x0D]', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS norm
          FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n, sum(length(norm)) AS chars FROM lines GROUP BY row),
hold AS (SELECT source, norm, text, min(doc_id) AS first FROM lines GROUP BY ALL),
host AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
freq AS (SELECT f.source, norm, keeper FROM (SELECT source, norm, arg_min(text, first) AS keeper, count(*) AS held FROM hold GROUP BY ALL) f
         JOIN host ON f.source IS NOT DISTINCT FROM host.source WHERE held > 10 AND held > 0.05::DOUBLE * texts),
gone AS (SELECT row, sum(length(lines.norm)) AS chars FROM lines JOIN freq
         ON lines.source IS NOT DISTINCT FROM freq.source AND lines.norm = freq.norm AND lines.text <> keeper GROUP BY row),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             coalesce(dup.chars - gone.chars < 0.5 * dup.chars, false) AS depleted
      FROM d LEFT JOIN cov USING (row) LEFT JOIN dup USING (row) LEFT JOIN gone USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT depleted AS kept FROM m
""")
def op6_quality_rules(spark, sf_dir):
    found = assess(documents(spark, sf_dir).select("doc_id", "source", "text"), BY_SHARE)
    return found.select("doc_id", *MEASURES, "base_failed", "kept")


def clean(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source",
          doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The kept rows of ``df`` without boilerplate lines, all columns as they came.

    Where lines went, the text is joined anew and ``n_chars`` (if present) counts it.
    """
    verdicts = assess(df, rules, text, host, doc_id).filter("kept").groupBy(
        F.col("doc_id").alias("v_id"), F.col("host").alias("v_host"), F.col("h").alias("v_h")).agg(F.first("boilerplate").alias("v_lines"))
    packed = df.select(F.struct("*").alias("d"), F.xxhash64(text_of(text), F.length(text_of(text))).alias("h"))
    joined = packed.join(verdicts, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("v_id"))
                         & F.col(f"d.`{host}`").eqNullSafe(F.col("v_host")) & (F.col("h") == F.col("v_h")))
    stays = F.filter(F.split(F.col(f"d.`{text}`"), "\n"), lambda line: ~F.array_contains(F.col("v_lines"), F.xxhash64(normalised(line))))
    changed = {text: F.when(F.col("v_lines").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(stays, "\n"))}
    if n_chars in df.columns:
        changed[n_chars] = F.when(F.col("v_lines").isNull(), F.col(f"d.`{n_chars}`")).otherwise(F.length(changed[text]).cast("long"))
    return joined.select(*[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in df.columns])


def stage(spark, docs, sf_dir):
    """Pipeline stage: rejected documents go, boilerplate lines of the others go."""
    return clean(docs, BY_SHARE)
