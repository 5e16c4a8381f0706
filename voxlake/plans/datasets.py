"""Split verification, dataset catalogs and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.errors import ChecksumError, DatasetError
from voxlake.functions.frames import csv_columns, csv_to_box, resampled_size
from voxlake.functions.text import canonical_names
from voxlake.operators import audits as A
from voxlake.operators import folds as folds_
from voxlake.operators.voxels import tight_boxes
from voxlake.schemas import AXES, DATASET_KEYS, NATIVE_SPACING_MM, TARGET_SPACING_MM
from voxlake.sources.manifests import file_digest, manifest_split, read_manifest_record
from voxlake.sources.tables import read_labels


def split_differences(cases: DataFrame, split: DataFrame, k: int, seed: int) -> DataFrame:
    """Cases whose re-derived fold differs from the given one."""
    derived = folds_.stratified_folds(cases, k, seed).select("case_id", "fold")
    return folds_.set_diff(derived, split, ["case_id", "fold"])


def verify_split(
    spark: SparkSession, labels_path: str, manifest_path: str, expected: int | None = 100
) -> bool:
    """Digest, label-file digest, and fold-for-fold re-derivation of a manifest."""
    record = read_manifest_record(spark, manifest_path)
    meta = record.select("seed", F.size("folds").alias("k"), "labels_csv_sha256").first()
    recorded = meta["labels_csv_sha256"] or "unknown"
    if recorded != "unknown":
        actual = file_digest(spark, labels_path).first()["sha256"]
        if actual != recorded:
            raise ChecksumError(f"label file digest is {actual}, manifest recorded {recorded}")
    cases = read_labels(spark, labels_path, expected)
    moved = split_differences(cases, manifest_split(record), meta["k"], meta["seed"])
    if not moved.isEmpty():
        raise ChecksumError("the manifest's folds are not those of its seed and labels")
    return True


def dataset_report(
    record: DataFrame,
    produced_roles: DataFrame,
    frozen_roles: DataFrame,
    labels: DataFrame,
    sidecars: DataFrame,
    images: DataFrame,
    spacing: Sequence[float] = TARGET_SPACING_MM,
    required: Sequence[str] = DATASET_KEYS,
) -> DataFrame:
    """(rule, n_checked, n_problems): one row per conformity rule.

    ``record`` has one row with a map ``fields``; ``images(path, spacing)`` may be
    empty, which counts as conforming.
    """

    def rule(name: str, checked: DataFrame, problems: DataFrame) -> DataFrame:
        one, none = F.lit(1), F.lit(0)
        label = F.lit(name).alias("rule")
        return checked.select(label, one.alias("checked"), none.alias("problem")).unionByName(
            problems.select(label, none.alias("checked"), one.alias("problem"))
        )

    absent = record.select(F.explode(A.missing_keys(F.col("fields"), required)).alias("k"))
    produced_folds = produced_roles.select("fold").distinct()
    frozen_folds = frozen_roles.select("fold").distinct()
    parts = [
        rule("required keys", record, absent),
        rule("fold count", frozen_folds, folds_.set_diff(produced_folds, frozen_folds, ["fold"])),
        rule("fold roles", frozen_roles, folds_.split_faithfulness(produced_roles, frozen_roles)),
        rule("sidecars", labels, A.missing_sidecars(labels, sidecars)),
        rule("spacing", images, A.spacing_audit(images, spacing)),
    ]
    names = ("required keys", "fold count", "fold roles", "sidecars", "spacing")
    out = record.sparkSession.createDataFrame(
        [(name, 0, 0) for name in names], "rule string, checked int, problem int"
    )
    for part in parts:
        out = out.unionByName(part)
    return out.groupBy("rule").agg(
        F.sum("checked").alias("n_checked"), F.sum("problem").alias("n_problems")
    )


def verify_dataset(*args, **kwargs) -> list:
    """The report's rows; raises if any rule has a problem."""
    rows = dataset_report(*args, **kwargs).collect()
    bad = {r["rule"]: r["n_problems"] for r in rows if r["n_problems"]}
    if bad:
        raise DatasetError(f"dataset does not conform: {bad}")
    return rows


def catalog_problems(
    numbered: DataFrame, truth: DataFrame, expected: DataFrame, shapes: DataFrame | None = None
) -> DataFrame:
    """(problem, split, case_id) rows that forbid an export.

    With ``shapes(path, sizes)`` a volume and a mask of different sizes are a problem, too.
    """
    pairs = A.pair_volume_mask(numbered, shapes)
    volumes = pairs.where(F.col("data").isNotNull())

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), "split", "case_id")

    counts = A.split_count_check(numbered, expected).where(~F.col("ok"))
    return (
        tag(A.duplicate_case_files(numbered), "duplicate file")
        .unionByName(tag(pairs.where("status = 'missing mask'"), "missing mask"))
        .unionByName(tag(pairs.where("status = 'shape differs'"), "shape differs"))
        .unionByName(tag(A.cases_without_truth(volumes, truth), "no truth row"))
        .unionByName(
            tag(counts.withColumn("case_id", F.lit(None).cast("bigint")), "case count")
        )
    )


def catalog_dataset(
    numbered: DataFrame,
    truth: DataFrame,
    sizes: DataFrame | None = None,
    spacing: Sequence[float] = NATIVE_SPACING_MM,
    target: Sequence[float] = TARGET_SPACING_MM,
) -> DataFrame:
    """Planned outputs, one row per paired case: names, lesions, resampled sizes, ``status``.

    Labels are written for train cases only, and only where the case has one lesion. A case
    without a truth row stays in the plan, with no lesions and a status that says so.
    """
    pairs = A.pair_volume_mask(numbered).where("status = 'paired'")
    planned = pairs.join(A.lesion_counts(truth), "case_id", "left").withColumn(
        "names", canonical_names(F.col("case_id"))
    )
    train = F.col("split") == "Train"
    planned = planned.select(
        "split",
        "case_id",
        "data",
        "mask",
        F.col("names.image").alias("image"),
        F.when(train, F.col("names.label")).alias("label"),
        F.when(train, F.col("names.sidecar")).alias("sidecar"),
        F.coalesce("n_lesions", F.lit(0)).cast("bigint").alias("n_lesions"),
        (train & F.coalesce("rejected", F.lit(False))).alias("rejected"),
        F.when(F.col("n_lesions").isNull(), "no truth row").otherwise("planned").alias("status"),
    )
    if sizes is None:
        return planned
    out = [
        resampled_size(F.col(f"n_{a}"), spacing[i], target[i]).alias(f"out_{a}")
        for i, a in enumerate(AXES)
    ]
    return planned.join(sizes.select("case_id", *out), "case_id", "left")


def convention_audit(
    voxels: DataFrame, truth: DataFrame, labels: DataFrame | None = None, n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(three best readings per case, overall summary) of the truth rows' convention."""
    chosen = truth if n is None else A.first_cases(truth, n)
    best = A.best_axis_matches(chosen, tight_boxes(voxels, keep_empty=True))
    if labels is not None:
        best = best.join(labels.select("case_id", "label"), "case_id", "left")
    return best, A.axis_mapping_summary(best)


def roundtrip_report(
    boxes: DataFrame, headers: DataFrame, original: Sequence[float] = NATIVE_SPACING_MM
) -> DataFrame:
    """Boxes with the residuals of a trip through their case's target grid."""
    spaced = A.case_spacing(boxes, headers, original)
    return A.roundtrip_audit(spaced, F.col("spacing"), original)


def sanity_check(voxels: DataFrame, truth: DataFrame) -> DataFrame:
    """Per case of either table: does the mask's tight box equal the truth box (``status``)."""
    center, size = csv_columns()
    boxes = truth.select("case_id", csv_to_box(center, size).alias("box"))
    return A.mask_vs_truth(tight_boxes(voxels, keep_empty=True), boxes)
