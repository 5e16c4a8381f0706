"""Row numbers within groups, also where one group holds most of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.skew import split_by_size
from voxlake.session import ensure_checkpoint_dir


def descending_nan_last(score: Column) -> Column:
    """Ascending sort key for a descending score; NaN comes last."""
    return -score


def rank_in_buckets(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "rank"
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` in two levels.

    ``bucket`` must be a deterministic, monotone function of ``order``. Rows are
    numbered inside (keys, bucket), and the bucket sizes are summed up per key, so
    no task sorts a whole group and no action runs.
    """
    bucketed = df.withColumn("_bucket", bucket)
    parts = [*keys, "_bucket"]
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        bucketed.groupBy(*parts)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return (
        bucketed.withColumn("_within", within)
        .join(offsets, parts)
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_within", "_before")
    )


def rank_by_global_sort(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """Row numbers from one range-partitioned sort of (keys, order).

    Spark's sampled range bounds cut a hot key into many partitions. The sorted
    rows are checkpointed, so that positions cannot change on recomputation; a
    position then needs only the number of the key's rows in earlier partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.orderBy(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_pos", 33))
    )
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(starts, [*keys, "_part"])
        .withColumn(out, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
        .drop("_pos", "_part", "_first", "_before")
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rank",
    max_group: int = 1_000_000,
) -> DataFrame:
    """Row numbers per group: a window for bounded groups, a global sort for hot ones."""
    bounded, hot = split_by_size(df, keys, max_group)
    numbered = bounded.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    )
    if hot is None:
        return numbered
    return numbered.unionByName(rank_by_global_sort(hot, keys, order, out))


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group with their rank.

    The rank filter is planned as a group limit before the shuffle: each map task
    sends at most ``n`` rows of a group, however hot it is.
    """
    if n <= 0:
        return df.withColumn(out, F.lit(0).cast("int")).limit(0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= n)
