"""Cross-validation folds: assignment, roles, statistics and comparisons.

A split is a long table ``(case_id, fold[, label])``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.operators.ranking import rank_in_buckets
from voxlake.schemas import EXPECTED_CASES, N_FOLDS, SPLIT_SEED


def stratified_folds(
    cases: DataFrame, k: int = N_FOLDS, seed: int = SPLIT_SEED, bucket_digits: int = 3
) -> DataFrame:
    """Seeded stratified fold of every ``(case_id, label)``.

    Cases of a class are shuffled by ``md5(seed:case_id)`` and dealt to the folds in
    turn; a class starts where the previous one stopped, so per-class and total fold
    sizes differ by at most one. Classes are taken in order of their smallest case.
    Two or three labels would make two or three sort tasks, so the shuffle order is
    ranked in buckets of the digest's leading hex digits.
    """
    if k < 2:
        raise ValueError(f"need at least 2 folds, got {k}")
    # one row holding the few classes, in order; a class starts after those before it
    classes = (
        cases.groupBy("label")
        .agg(F.min("case_id").alias("first"), F.count("*").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("first", "label", "n"))).alias("_classes"))
    )
    before = F.aggregate(
        F.slice("_classes", F.lit(1), F.col("_at")),
        F.lit(0).cast("bigint"),
        lambda total, c: total + c["n"],
    )
    starts = classes.select("_classes", F.posexplode("_classes").alias("_at", "_class")).select(
        F.col("_class.label").alias("label"), before.alias("_start")
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("case_id").cast("string")))
    shuffled = rank_in_buckets(
        cases.select("case_id", "label").withColumn("_md5", digest),
        ["label"],
        [F.col("_md5"), F.col("case_id")],
        F.substring("_md5", 1, bucket_digits),
        "_rank",
    )
    dealt = F.pmod(F.col("_start") + F.col("_rank") - 1, F.lit(k)).cast("int")
    return shuffled.join(starts, "label").select("case_id", dealt.alias("fold"), "label")


def _check_fold(k: int, n_folds: int) -> None:
    if not 0 <= k < n_folds:
        raise ValueError(f"fold {k} is outside 0..{n_folds - 1}")


def train_ids(split: DataFrame, k: int, n_folds: int = N_FOLDS) -> DataFrame:
    """Cases of every fold but ``k``."""
    _check_fold(k, n_folds)
    return split.where(F.col("fold") != k).select("case_id")


def oof_ids(split: DataFrame, k: int, n_folds: int = N_FOLDS) -> DataFrame:
    """Cases of fold ``k``, which its detector has not seen."""
    _check_fold(k, n_folds)
    return split.where(F.col("fold") == k).select("case_id")


def sorted_ids(df: DataFrame) -> DataFrame:
    return df.select("case_id").orderBy("case_id")


def fold_roles(split: DataFrame, k: int = N_FOLDS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., fold, role, case_id) for every fold: a case validates its own fold only."""
    role = F.when(F.col("_f") == F.col("fold"), "val").otherwise("train")
    return split.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *keys, F.col("_f").alias("fold"), role.alias("role"), "case_id"
    )


def fold_label_stats(split: DataFrame) -> DataFrame:
    """Benign and malignant counts per fold, with the overall row (fold NULL)."""
    benign = F.count_if(F.col("label") == "B")
    n = F.count("*")
    return (
        split.rollup("fold")
        .agg(
            F.grouping_id().alias("level"),
            benign.alias("benign"),
            (n - benign).alias("malignant"),
            F.when(n > 0, benign / n).otherwise(F.lit(0.0)).alias("benign_fraction"),
        )
        .withColumn("is_total", F.col("level") == 1)
        .drop("level")
    )


def degenerate_folds(split: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Per fold: does its benign share stray from the overall one by more than ``tolerance``."""
    stats = fold_label_stats(split)
    # the statistics hold one row per fold, so one window partition is small
    overall = F.max(F.when(F.col("is_total"), F.col("benign_fraction"))).over(Window.partitionBy())
    return (
        stats.withColumn("overall_fraction", overall)
        .where(~F.col("is_total"))
        .select(
            "fold",
            "benign_fraction",
            "overall_fraction",
            (F.abs(F.col("benign_fraction") - F.col("overall_fraction")) > tolerance).alias(
                "degenerate"
            ),
        )
    )


def partition_check(split: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that break disjoint-and-cover: in several folds, in none, or unknown."""
    placed = split.groupBy("case_id").agg(F.count("*").alias("n_folds"))
    known = cases.select("case_id").distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when(F.col("_known").isNull(), "unknown case")
        .when(F.col("n_folds").isNull(), "in no fold")
        .when(F.col("n_folds") > 1, "in several folds")
    )
    return (
        known.join(placed, "case_id", "full_outer")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("case_id", F.coalesce("n_folds", F.lit(0)).alias("n_folds"), "reason")
    )


def set_diff(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Symmetric difference of two key sets; ``side`` says which one holds the key. Nulls are equal, as in EXCEPT.

    One aggregate of both sides: a task holds each key once and sorts nothing.
    """
    sides = left.select(*on, F.lit(1).alias("_side")).unionByName(right.select(*on, F.lit(2).alias("_side")))
    return (
        sides.groupBy(*on)
        .agg(F.bit_or("_side").alias("_sides"))
        .where("_sides <> 3")
        .select(*on, F.when(F.col("_sides") == 1, "left").otherwise("right").alias("side"))
    )


def missing_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_anti")


def missing_columns(required: Sequence[str], present: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(present))


def split_faithfulness(produced_roles: DataFrame, frozen_roles: DataFrame) -> DataFrame:
    """Role rows in which a produced split differs from the frozen one."""
    return set_diff(produced_roles, frozen_roles, ["fold", "role", "case_id"]).select(
        "fold",
        "role",
        "case_id",
        F.when(F.col("side") == "left", "unexpected").otherwise("missing").alias("problem"),
    )


def case_scope(
    spark: SparkSession,
    split: DataFrame,
    val: tuple[int, int] = (100, 130),
    test: tuple[int, int] = (130, 200),
) -> DataFrame:
    """(split, case_id) of a run: train cases from the split, val and test by number range."""
    train = split.select(F.lit("train").alias("split"), "case_id").distinct()
    ranges = [
        spark.range(*bounds).select(F.lit(name).alias("split"), F.col("id").alias("case_id"))
        for name, bounds in (("val", val), ("test", test))
    ]
    return train.unionByName(ranges[0]).unionByName(ranges[1])


def expected_scope_sizes() -> dict[str, int]:
    return dict(EXPECTED_CASES)


# --- digests ----------------------------------------------------------------


def manifest_payload(folds: Column, seed: Column, version: Column) -> Column:
    """Compact key-sorted JSON of the digested part of a manifest."""
    return F.to_json(
        F.struct(
            folds.alias("folds"), seed.alias("seed"), version.alias("splitter_version")
        )
    )


def manifest_digest(folds: Column, seed: Column, version: Column) -> Column:
    return F.sha2(manifest_payload(folds, seed, version), 256)


def split_digests(split: DataFrame, cases_per_block: int = 10_000) -> DataFrame:
    """sha256 of the ordered case list per (fold, id block): a split too large for one
    document is compared block by block, in one distributed pass."""
    block = F.floor(F.col("case_id") / cases_per_block)
    ids = F.array_sort(F.collect_list("case_id"))
    return (
        split.select("fold", "case_id", block.alias("block"))
        .groupBy("fold", "block")
        .agg(
            F.count("*").alias("n_cases"),
            F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("sha256"),
        )
    )
