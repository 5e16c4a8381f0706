"""Hot-key helpers: find them, and join them without one task getting it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# tasks that share a hot key
SALTS = 16


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows. At most ``rows / limit`` keys qualify."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n")


def split_by_size(
    df: DataFrame, keys: Sequence[str], limit: int, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of bounded groups, rows of hot groups or None when there are none).

    ``counted`` has the keys of ``df``, a row each, where these are cheaper to get.
    """
    hot = hot_groups(df if counted is None else counted, keys, limit)
    if hot.isEmpty():
        return df, None
    on = list(keys)
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that a join never broadcasts.

    For tables of a row per voxel: Spark estimates a table that is generated from another as large
    as that one, so it would broadcast a million times what it expects.
    """
    return df.hint("merge")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    salts: int | str = SALTS,
) -> DataFrame:
    """Equi-join whose hot left keys are split over ``salts`` tasks.

    The salt is a hash of the ``spread`` columns, so a retried task computes the
    same one. ``right`` is repeated per salt and must hold few rows per key. With
    ``condition`` the join columns of ``right`` are dropped from an inner result.
    ``salts`` may name a column of both sides that is a function of the key: only hot keys
    need to be repeated then.
    """
    if how not in ("inner", "left_semi", "left_anti", "left"):
        raise ValueError(f"salted_join cannot do {how!r}")
    count = F.col(salts) if isinstance(salts, str) else F.lit(salts)
    salted = left.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), count).cast("int")
    )
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    if isinstance(salts, str):
        repeated = repeated.drop(salts)
    # the repeats are many more rows than Spark expects
    repeated = shuffled(repeated)
    keys = [*on, "_salt"]
    if condition is None:
        return salted.join(repeated, keys, how).drop("_salt")
    other = repeated.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in repeated.columns if c not in keys],
    )
    matches = condition
    for k in keys:
        matches = matches & (F.col(k) == F.col(f"_r_{k}"))
    joined = salted.join(other, matches, how)
    return joined.drop("_salt", *[f"_r_{k}" for k in keys])
