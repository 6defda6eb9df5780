"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source has a target amount of words. A document of the source is expected
``rate = target / source_size`` times. Documents stand in a row within their source (by
size, then id, so that neighbours weigh alike); the expected copies are summed along the
row, one offset per source is added, and a document is emitted once for every integer the
running sum crosses. The offset is a hash of the seed and the source, so reruns agree.

The running sum is taken without putting a source into one task: rows are range-sorted,
each sorted partition knows its own row count, and only the per-partition counts are
summed in order (a table of partitions, not of rows).

Defined results: null text or size counts as 0 words; a null source is a source of its
own, last in order; a source of size 0 has target 0 and is taken 0 times; rows that agree
in source, size and id are interchangeable; an empty table gives an empty result. Input
columns named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfield.llm.common import WORD, materialize, text_of, without
from crossfield.llm.registry import documents, register

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "copies")


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Targets per source from a (source, source_size) table: one row per source.

    Weighted shares of all words, each stopped at ``cap`` times its source, the excess
    shared again by weight. With sources in ascending order of cap per weight, the level
    that remains after stopping the first k follows from running sums; the first source
    not above it fixes the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    limit = F.col("source_size") * cap
    by_limit = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = (
        sizes.withColumns({"weight": weight, "stop": limit.cast("double")})
        .withColumn("level", (F.sum("source_size").over(everything).cast("double")
                              - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("stop") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    )
    return leveled.select("source", "source_size", F.least(F.col("weight") * F.col("level"), F.col("stop")).alias("target"))


def mix(df: DataFrame, size: Column, source: str = "source", order: tuple[str, ...] = ("doc_id",),
        weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of ``df`` with size, source_size, target and copies (how often to take the row)."""
    spark = df.sparkSession
    rows = without(df.withColumn("_llm_size", F.coalesce(size, F.lit(0)).cast("long")), *ADDED)
    rows = materialize(rows.withColumn("_llm_row", F.monotonically_increasing_id()), "mix-rows")
    keys = rows.select(F.col("_llm_row"), F.col(source).alias("source"), F.col("_llm_size").alias("size"),
                       *[F.col(c).alias(f"_llm_o{i}") for i, c in enumerate(order)])
    by = [F.col("source").asc_nulls_last(), F.col("size"), *[F.col(f"_llm_o{i}") for i in range(len(order))], F.col("_llm_row")]
    # The position grows along the sorted table: partition number in the high bits.
    ranged = materialize(
        keys.repartitionByRange(*by).sortWithinPartitions(*by)
        .select("_llm_row", "source", "size", F.monotonically_increasing_id().alias("at")), "mix-order")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("source", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("at").alias("first"))
    parts = materialize(parts, "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.select("source", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    plan = (
        begun.join(targets.withColumnRenamed("source", "_llm_s"), F.col("source").eqNullSafe(F.col("_llm_s"))).drop("_llm_s")
        .withColumns({"rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
                      "offset": offset})
    )
    plan = materialize(plan, "mix-plan").select(F.col("source").alias("_llm_s"), F.col("part").alias("_llm_p"),
                                                "first", "ahead", "source_size", "target", "rate", "offset")
    rank = F.col("ahead") + F.col("at") - F.col("first")
    crossed = F.floor((rank + 1) * F.col("rate") + F.col("offset")) - F.floor(rank * F.col("rate") + F.col("offset"))
    chosen = (
        ranged.join(plan, F.col("source").eqNullSafe(F.col("_llm_s")) & (F.col("part") == F.col("_llm_p")))
        .select("_llm_row", "source_size", "target", F.least(crossed, F.lit(cap)).cast("int").alias("copies"))
    )
    return rows.join(chosen, "_llm_row").withColumnRenamed("_llm_size", "size").drop("_llm_row")


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy; rows taken 0 times go."""
    return (mixed.filter(F.col("copies") > 0)
            .withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_llm_copy"))


@register("op7_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight,
             source_size * 3::DOUBLE AS stop FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
t AS (SELECT *, least(weight * max(CASE WHEN stop / weight >= own THEN own END) OVER (), stop) AS target FROM l),
r AS (SELECT doc_id, d.source, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix-1' || coalesce(d.source, '')), 1, 4))::INT / 65536::DOUBLE AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, least(floor((k + 1) * rate + u) - floor(k * rate + u), 3)::BIGINT * size AS taken FROM r
""")
def op7_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("n"))
    mixed = mix(docs, F.col("n"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents in the number of copies the mix takes."""
    packed = docs.select(F.struct("*").alias("_llm_doc"), "source", "doc_id", word_count("text").alias("_llm_n"))
    return emit(mix(packed, F.col("_llm_n"))).select("_llm_doc.*")
