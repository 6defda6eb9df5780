"""Plan building blocks that hold when one key owns a large share of the rows.

Four questions come up in nearly every operator, and each has one answer here:

* ``materialize``   - cut lineage of a small intermediate through the shared
  checkpoint folder, so that its size can be measured and its plan reused.
* ``attach``        - bring per-group facts back to the rows. Broadcast when the
  measured fact table is small in rows and bytes, otherwise a shuffle join in which the
  rows of a hot key are dealt to blocks and its facts are copied to each.
* ``grid_join``     - join many rows with many rows per key. A hot key's rows are dealt to
  blocks on both sides, and every pair of blocks is one key of the shuffle: a task sees at
  most ``cell`` rows of a side of one key, however many the key has.
* ``group_sizes``   - how many rows each key has, and which keys are hot.

A key is *hot* when it has more rows than one task should see. The table of hot keys is sent
to the tasks; the limit is raised, if need be, until that table has at most
``BROADCAST_ROWS`` rows, which it has as soon as the limit is rows / ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest number of rows one task may hold for a single key.
TASK_ROWS = 1_000_000
# Largest number of rows, and of bytes, of a table that is broadcast.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 64_000_000
# Rows of one side that meet in one cell of a many-to-many join.
CELL_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small intermediate once and cut its lineage."""
    if getattr(df, "lineage_cut", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out.lineage_cut = True
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Like ``materialize``, as Parquet beside the checkpoints, deleted when the application ends.

    A checkpoint keeps the size that the planner guessed for its plan, and a join's guess is the
    product of both sides. In a chain of joins and checkpoints the guesses square again and again,
    until planning alone takes minutes. Files have a size of their own.

    ``part_rows`` bounds the rows of a partition, whoever scans the table, without a shuffle: files
    have at most as many rows, and a session like this one reads each file as a partition.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "stored")
    df.write.option("maxRecordsPerFile", part_rows or 0).parquet(path)
    if part_rows:
        spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    out = spark.read.schema(df.schema).parquet(path)
    out.lineage_cut = True
    return out


def rows_up_to(df: DataFrame, limit: int) -> bool:
    """Whether a (materialized) table has at most ``limit`` rows."""
    if getattr(df, "counted_rows", None) is None:
        df.counted_rows = df.count()
    return df.counted_rows <= limit


def _wide(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))


def bytes_of(df: DataFrame) -> int:
    """Bytes of a (materialized) table: eight for a plain value, the written length of any other."""
    if getattr(df, "counted_bytes", None) is None:
        wide = [F.col(f"`{f.name}`") for f in df.schema.fields if _wide(f.dataType)]
        length = F.length(F.to_json(F.struct(*wide))) if wide else F.lit(0)
        row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
        df.counted_rows = row[0]
        df.counted_bytes = row[0] * 8 * len(df.columns) + row[1]
    return df.counted_bytes


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a (materialized) table is small enough to be sent to every task."""
    return bytes_of(df) <= BROADCAST_BYTES and rows_up_to(df, BROADCAST_ROWS if rows is None else rows)


def checked_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast a table only once its rows and bytes are known to be small."""
    return F.broadcast(df) if fits(df, limit) else df


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys, so that a NULL key is a group like any other."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


@dataclass
class GroupSizes:
    table: DataFrame        # keys + group_rows, materialized
    keys: list[str]
    limit: int
    largest: int

    @property
    def bounded(self) -> bool:
        return self.largest <= self.limit

    def hot(self) -> DataFrame:
        return self.table.filter(F.col("group_rows") > self.limit).select(*self.keys)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ordinary keys and rows of hot keys.

        The keys are looked up in the broadcast hot table; should it not fit, keys of the
        most rows still do, and the others are joined by shuffle, dealt to blocks.
        """
        marked = attach(df, self.hot().withColumn("__hot", F.lit(True)), self.keys)
        is_hot = F.col("__hot").isNotNull()
        return marked.filter(~is_hot).drop("__hot"), marked.filter(is_hot).drop("__hot")


def group_sizes(df: DataFrame, keys: Sequence[str], limit: int = TASK_ROWS) -> GroupSizes:
    """Count rows per key (combined map-side) and find the largest."""
    table = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")))
    largest = table.agg(F.max("group_rows")).first()[0] or 0
    return GroupSizes(table, list(keys), limit, largest)


def _any_row(df: DataFrame) -> Column:
    """A hash of the whole row: the same after a task is run again."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def hot_blocks(counts: DataFrame, rows: Column, limit: int) -> DataFrame:
    """Those of ``counts`` with more than ``limit`` rows; raised until few enough to be broadcast."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return materialize(counts.filter(rows > F.lit(max(limit, total // BROADCAST_ROWS))))


def attach(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_rows: int | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Join one-row-per-key ``facts`` to ``df`` without piling a hot key on one task.

    Facts that are too large to broadcast are joined by shuffle; the rows of a key with more
    than ``hot_rows`` are dealt to blocks by a hash of the row, its facts copied to each.
    """
    keys, hot_rows = list(keys), hot_rows or TASK_ROWS
    facts = materialize(facts)
    if fits(facts, broadcast_rows):
        return _join_facts(df, F.broadcast(facts), keys, how)
    counts = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
    blocks = hot_blocks(counts, F.col("__rows"), hot_rows)
    if blocks.isEmpty():
        return _join_facts(df, facts, keys, how)
    blocks = F.broadcast(blocks.select(*keys, F.ceil(F.col("__rows") / hot_rows).alias("__blocks")))
    of_row, of_facts = F.coalesce("__blocks", F.lit(1)), F.coalesce("__blocks", F.lit(1))
    dealt = _join_facts(df, blocks, keys, "left").withColumn("__block", F.pmod(_any_row(df), of_row)).drop("__blocks")
    copied = _join_facts(facts, blocks, keys, "left").withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), of_facts - 1))).drop("__blocks")
    return _join_facts(dealt, copied, [*keys, "__block"], how).drop("__block")


def rows_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows) of every key without nulls, combined before the shuffle."""
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def grid_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", cell: int | None = None,
    left_counts: DataFrame | None = None, right_counts: DataFrame | None = None,
) -> DataFrame:
    """Equality join of many rows with many rows per key (``inner`` or ``left``), hot keys in a grid.

    A key with a rows on one side and b on the other is cut into ceil(a / cell) x ceil(b / cell)
    cells; its left rows are copied once for every block of the right side and the other way
    round, so every pair of rows meets in exactly one cell. Nothing but the table of hot keys is
    broadcast. Columns other than the keys must differ. A null key joins nothing. Counts of a
    side (keys and ``rows``) that the caller knows spare a pass over it.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"grid_join knows inner and left, not {how}")
    keys, cell = list(keys), cell or CELL_ROWS
    left = left.select(*[F.col(f"`{c}`").alias(c) for c in left.columns])  # both may come from one table
    right = right.select(*[F.col(f"`{c}`").alias(c) for c in right.columns])
    counts = [(known or rows_per_key(side, keys)).select(*keys, F.col("rows").alias(name))
              for side, known, name in ((left, left_counts, "__a"), (right, right_counts, "__b"))]
    both = materialize(counts[0].join(counts[1], keys))
    most = F.greatest("__a", "__b")
    blocks = hot_blocks(both, most, cell)
    if blocks.isEmpty():
        return left.join(right, keys, how)
    p, q = (F.ceil(F.col(c) / F.lit(cell)).cast("long") for c in ("__a", "__b"))
    blocks = F.broadcast(blocks.select(*keys, p.alias("__p"), q.alias("__q")))
    left_own, right_own = _any_row(left), _any_row(right)

    def dealt(side: DataFrame, row: Column, own: str, other: str) -> DataFrame:
        placed = _join_facts(side, blocks, keys, "left")
        return placed.withColumns({
            f"{own}b": F.coalesce(F.pmod(row, F.col(own)), F.lit(0)),
            f"{other}b": F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))}).drop("__p", "__q")

    pairs = dealt(left, left_own, "__p", "__q").join(dealt(right, right_own, "__q", "__p"), [*keys, "__pb", "__qb"]).drop("__pb", "__qb")
    if how == "inner":
        return pairs
    found = both.select(*keys, F.lit(True).alias("__found"))
    lonely = attach(left, found, keys).filter("__found IS NULL").drop("__found")
    return pairs.unionByName(lonely, allowMissingColumns=True)


def _join_facts(df: DataFrame, facts: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = facts.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in facts.columns if c not in keys],
    )
    condition = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return df.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
