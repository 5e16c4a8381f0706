"""Conformity audits over file catalogs, headers, boxes and dataset records.

Audits return rows (one per checked item or rule); ``require_*`` wrappers raise.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.errors import DatasetError, HeaderError
from voxlake.functions import boxes as B
from voxlake.functions import frames
from voxlake.functions.text import case_id_from_name, sidecar_name
from voxlake.schemas import (
    AXES,
    DATASET_KEYS,
    HEADER_ATOL,
    HEADER_RTOL,
    NATIVE_SPACING_MM,
    SPACING_ATOL,
    TRUTH_IOU_GATE,
)

# --- headers ----------------------------------------------------------------


def _far_from(value: Column, expected: float) -> Column:
    """numpy-style closeness, NaN and NULL counting as far."""
    tolerance = HEADER_ATOL + HEADER_RTOL * abs(expected)
    return ~F.coalesce(F.abs(value - F.lit(expected)) <= F.lit(tolerance), F.lit(False)) | F.isnan(
        value
    )


def header_problem(shape: Column | None = None) -> Column:
    """First reason why a header is not the identity placeholder, NULL if it is.

    Reads the columns of ``schemas.HEADER``; ``shape`` is the array's own shape.
    """
    directions, origin, sizes = F.col("directions"), F.col("origin"), F.col("sizes")
    square = (F.size(directions) == 3) & F.forall(directions, lambda row: F.size(row) == 3)
    off_identity = F.lit(False)
    for i in range(3):
        for j in range(3):
            off_identity = off_identity | _far_from(directions[i][j], float(i == j))
    off_origin = F.size(origin) != 3
    for i in range(3):
        off_origin = off_origin | _far_from(F.get(origin, F.lit(i)), 0.0)
    reasons = [
        F.when(F.col("dim") != 3, "not 3-dimensional"),
        F.when(directions.isNull(), "no directions"),
        F.when(~square, "directions not 3x3"),
        F.when(F.when(square, off_identity).otherwise(False), "directions not identity"),
        F.when(origin.isNull(), "no origin"),
        F.when(off_origin, "origin not zero"),
        F.when(sizes.isNull(), "no sizes"),
    ]
    if shape is not None:
        reasons.append(F.when(sizes != shape, "sizes differ from shape"))
    return F.coalesce(*reasons)


def dtype_problem(expected: str = "uint8") -> Column:
    return F.when(
        ~F.coalesce(F.col("dtype") == expected, F.lit(False)),
        F.concat(F.lit("dtype is "), F.coalesce(F.col("dtype"), F.lit("missing"))),
    )


def header_audit(headers: DataFrame, shape: Column | None = None) -> DataFrame:
    """Every file with its header status and first reason."""
    return headers.withColumn("reason", header_problem(shape)).withColumn(
        "status", F.when(F.col("reason").isNull(), "pass").otherwise("fail")
    )


def header_audit_report(headers: DataFrame, shape: Column | None = None) -> DataFrame:
    """File counts per status, with the overall row (status NULL)."""
    return (
        header_audit(headers, shape)
        .rollup("status")
        .agg(F.count("*").alias("n_files"))
        .select("status", "n_files")
    )


def require_headers(headers: DataFrame, shape: Column | None = None) -> None:
    bad = header_audit(headers, shape).where("status = 'fail'").select("path", "reason").limit(5)
    found = bad.collect()
    if found:
        raise HeaderError(f"headers are not the placeholder: {[tuple(r) for r in found]}")


def spacing_audit(
    images: DataFrame, expected: Sequence[float], atol: float = SPACING_ATOL
) -> DataFrame:
    """(path, axis) rows whose spacing strays from ``expected`` by more than ``atol``."""
    wanted = F.array(*[F.lit(float(v)) for v in expected])
    axes = F.array(*[F.lit(a) for a in AXES])
    rows = images.select(
        "path", F.posexplode(F.arrays_zip("spacing", wanted.alias("expected"), axes.alias("axis")))
    )
    return rows.select(
        "path",
        F.col("col.axis").alias("axis"),
        F.col("col.spacing").alias("actual"),
        F.col("col.expected").alias("expected"),
    ).where(F.abs(F.col("actual") - F.col("expected")) > atol)


def missing_keys(record: Column, required: Sequence[str] = DATASET_KEYS) -> Column:
    """Required keys that a map column lacks."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.map_keys(record))


# --- files ------------------------------------------------------------------


def with_case_ids(files: DataFrame) -> DataFrame:
    """Catalog rows with the case number of their name, by file kind."""
    number = F.when(
        F.col("kind") == "DATA", case_id_from_name(F.col("path"), "DATA")
    ).otherwise(case_id_from_name(F.col("path"), "MASK"))
    return files.withColumn("case_id", number)


def pair_volume_mask(numbered: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """(split, case_id, data, mask, status): paired, missing mask, or extra mask.

    With ``shapes(path, sizes)`` pairs of different sizes have the status ``shape differs``.

    One aggregate over the catalog replaces a full outer join of its two halves. Of
    several files of a kind the first path stands; duplicates are a report of their
    own.
    """
    paths = numbered.groupBy("split", "case_id").agg(
        F.min(F.when(F.col("kind") == "DATA", F.col("path"))).alias("data"),
        F.min(F.when(F.col("kind") == "MASK", F.col("path"))).alias("mask"),
    )
    status = (
        F.when(F.col("data").isNull(), "extra mask")
        .when(F.col("mask").isNull(), "missing mask")
        .otherwise("paired")
    )
    paired = paths.withColumn("status", status)
    if shapes is None:
        return paired
    data = shapes.select(F.col("path").alias("data"), F.col("sizes").alias("_data_sizes"))
    mask = shapes.select(F.col("path").alias("mask"), F.col("sizes").alias("_mask_sizes"))
    differs = (F.col("status") == "paired") & (F.col("_data_sizes") != F.col("_mask_sizes"))
    return (
        paired.join(data, "data", "left")
        .join(mask, "mask", "left")
        .withColumn("status", F.when(differs, "shape differs").otherwise(F.col("status")))
        .select(*paired.columns)
    )


def shape_mismatches(volumes: DataFrame, masks: DataFrame) -> DataFrame:
    """Cases whose volume and mask sizes differ."""
    other = masks.select("case_id", F.col("sizes").alias("mask_sizes"))
    return volumes.join(other, "case_id").where(F.col("sizes") != F.col("mask_sizes"))


def duplicate_case_files(numbered: DataFrame) -> DataFrame:
    """(split, kind, case_id) with more than one file.

    The row names the first and last path; ``surplus_files`` lists them all, a row each, so a
    case with very many copies is never one row.
    """
    keys = ["split", "kind", "case_id"]
    return numbered.groupBy(*keys).agg(
        F.count("*").alias("n_files"),
        F.min("path").alias("first_path"),
        F.max("path").alias("last_path"),
    ).where("n_files > 1")


def surplus_files(numbered: DataFrame) -> DataFrame:
    """(split, kind, case_id, path): every file of a case beyond its first path, a row each."""
    keys = ["split", "kind", "case_id"]
    copies = duplicate_case_files(numbered).select(*keys, "first_path")
    return numbered.join(copies, keys).where(F.col("path") > F.col("first_path")).select(*keys, "path")


def split_count_check(numbered: DataFrame, expected: DataFrame) -> DataFrame:
    """Discovered against expected DATA cases per split; nothing found counts as 0."""
    found = (
        numbered.where(F.col("kind") == "DATA")
        .groupBy("split")
        .agg(F.count_distinct("case_id").alias("n_found"))
    )
    return (
        expected.join(found, "split", "left")
        .withColumn("n_found", F.coalesce("n_found", F.lit(0)))
        .withColumn("ok", F.col("n_found") == F.col("n_expected"))
    )


def order_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def first_cases(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("case_id").limit(n)


def missing_sidecars(labels: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Label files without a JSON file of the same stem next to them."""
    wanted = labels.withColumn("sidecar", sidecar_name(F.col("path")))
    have = sidecars.select(F.element_at(F.split("path", "/"), -1).alias("sidecar")).distinct()
    return wanted.join(have, "sidecar", "left_anti")


def cases_without_truth(files: DataFrame, truth: DataFrame) -> DataFrame:
    return files.join(truth.select("case_id"), "case_id", "left_anti")


def attach_truth_rows(files: DataFrame, truth: DataFrame) -> DataFrame:
    """Each file with its truth rows; a file without any fails the job."""
    flagged = files.join(truth.withColumn("_has", F.lit(True)), "case_id", "left")
    message = F.concat(F.lit("no truth row for case "), F.col("case_id").cast("string"))
    return flagged.where(
        F.when(F.col("_has"), F.lit(True)).otherwise(F.raise_error(message))
    ).drop("_has")


def lesion_counts(truth: DataFrame) -> DataFrame:
    """Truth rows per case; several rows do not fit a single-instance encoding."""
    return (
        truth.groupBy("case_id")
        .agg(F.count("*").alias("n_lesions"))
        .withColumn("rejected", F.col("n_lesions") > 1)
    )


def require_single_lesions(truth: DataFrame) -> None:
    row = lesion_counts(truth).agg(F.count("*").alias("n"), F.count_if("rejected").alias("bad")).first()
    if row["n"] == 0:
        raise DatasetError("no truth rows")
    if row["bad"]:
        raise DatasetError(f"{row['bad']} cases have more than one lesion")


def dataset_build_summary(pairs: DataFrame, lesions: DataFrame) -> DataFrame:
    """One row: volumes per split and lesions overall."""
    joined = pairs.where("status = 'paired'").join(lesions, "case_id", "left")
    counts = [
        F.count_if(F.col("split") == name).alias(alias)
        for name, alias in (("Train", "n_train"), ("Validation", "n_val"), ("Test", "n_test"))
    ]
    total = F.coalesce(F.sum("n_lesions"), F.lit(0)).alias("total_lesions")
    return joined.agg(*counts, total)


# --- box conventions --------------------------------------------------------


def axis_matches(center: Sequence[Column], size: Sequence[Column], mask_box: Column) -> Column:
    """The 12 readings of a center/size row (axis order x inclusivity), best first.

    ``array<struct<residual, ordinal, perm, exclusive, min_residual, max_residual>>``,
    sorted by residual and then in permutation order, all inside the row.
    """
    minima, maxima = frames.csv_endpoints(center, size)
    entries = []
    for ordinal, (perm, offset) in enumerate(
        (p, o) for p in permutations(range(3)) for o in (0, 1)
    ):
        low = F.greatest(
            *[F.abs(minima[p] - B.lower(mask_box, a)) for p, a in zip(perm, AXES, strict=True)]
        )
        high = F.greatest(
            *[
                F.abs(maxima[p] - (B.upper(mask_box, a) + offset))
                for p, a in zip(perm, AXES, strict=True)
            ]
        )
        entries.append(
            F.struct(
                F.greatest(low, high).alias("residual"),
                F.lit(ordinal).alias("ordinal"),
                F.lit("".join(map(str, perm))).alias("perm"),
                F.lit(bool(offset)).alias("exclusive"),
                low.alias("min_residual"),
                high.alias("max_residual"),
            )
        )
    return F.sort_array(F.array(*entries))


def axis_permutation_search(truth: DataFrame, mask_boxes: DataFrame) -> DataFrame:
    """All 12 readings per case, as rows with status ``ok``.

    A case that lacks its truth row or its mask box has one row without a reading; its status
    is ``no truth``, ``no mask`` or ``empty mask``.
    """
    center, size = frames.csv_columns()
    known = truth.withColumn("_truth", F.lit(True))
    masks = mask_boxes.select("case_id", "box", F.lit(True).alias("_mask"))
    joined = known.join(masks, "case_id", "full")
    status = _match_status(F.col("_truth"), F.col("_mask"), F.col("box"))
    readings = F.when(status == "ok", axis_matches(center, size, F.col("box")))
    matches = F.posexplode_outer(readings).alias("pos", "m")
    return joined.select("case_id", status.alias("status"), matches).select(
        "case_id", "status", F.coalesce(F.col("pos") + 1, F.lit(1)).alias("rank"), "m.*"
    )


def _match_status(truth: Column, mask: Column, box: Column) -> Column:
    return (
        F.when(truth.isNull(), "no truth")
        .when(mask.isNull(), "no mask")
        .when(box.isNull(), "empty mask")
        .otherwise("ok")
    )


def best_axis_matches(truth: DataFrame, mask_boxes: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best readings per case."""
    return axis_permutation_search(truth, mask_boxes).where(F.col("rank") <= n)


def axis_mapping_summary(best: DataFrame) -> DataFrame:
    """One row over all cases: readings in use, consistency and residuals."""
    return best.where("rank = 1 AND status = 'ok'").agg(
        F.count("*").alias("n_cases"),
        F.array_sort(F.collect_set("perm")).alias("perms"),
        (F.count_distinct("perm") == 1).alias("perm_consistent"),
        F.array_sort(F.collect_set("exclusive")).alias("exclusivities"),
        (F.count_distinct("exclusive") == 1).alias("exclusivity_consistent"),
        F.max("residual").alias("max_residual"),
        F.avg("residual").alias("mean_residual"),
    )


def case_spacing(
    boxes: DataFrame, headers: DataFrame, default: Sequence[float] = NATIVE_SPACING_MM
) -> DataFrame:
    """Boxes with their case's spacing, or the default where no header gives one."""
    fallback = F.array(*[F.lit(float(v)) for v in default])
    return boxes.join(headers.select("case_id", "spacing"), "case_id", "left").withColumn(
        "spacing", F.coalesce("spacing", fallback)
    )


def mask_vs_truth(
    mask_boxes: DataFrame, truth_boxes: DataFrame, gate: float = TRUTH_IOU_GATE
) -> DataFrame:
    """Per case: IoU of mask box and truth box, exact equality, the gate and a status.

    Every case of either side has a row. Where a box is missing, ``ok`` is false and the status
    says which: ``no truth``, ``no mask`` or ``empty mask``; else it is ``ok`` or ``differs``.
    """
    other = truth_boxes.select(
        "case_id", F.col("box").alias("truth_box"), F.lit(True).alias("_truth")
    )
    masks = mask_boxes.select("case_id", F.col("box").alias("mask_box"), F.lit(True).alias("_mask"))
    status = _match_status(F.col("_truth"), F.col("_mask"), F.col("mask_box"))
    same = F.col("equal") & (F.col("iou") >= gate)
    return (
        masks.join(other, "case_id", "full")
        .withColumn("iou", B.iou_3d(F.col("mask_box"), F.col("truth_box")))
        .withColumn("equal", F.col("mask_box") == F.col("truth_box"))
        .withColumn("ok", F.coalesce(same, F.lit(False)))
        .withColumn("status", F.when((status == "ok") & ~F.col("ok"), "differs").otherwise(status))
        .drop("_truth", "_mask")
    )


def require_masks(checked: DataFrame) -> DataFrame:
    """Rows of a mask check; the job fails on a case without mask, foreground or truth row."""
    missing = F.col("status").isin("no truth", "no mask", "empty mask")
    message = F.concat(F.col("status"), F.lit(": case "), F.col("case_id").cast("string"))
    failed = F.raise_error(message).cast("string")
    return checked.withColumn("status", F.when(missing, failed).otherwise(F.col("status")))


def roundtrip_audit(
    boxes: DataFrame, target: Sequence[float], original: Sequence[float] | Column
) -> DataFrame:
    """Boxes with their recovered form and residual record."""
    recovered = boxes.withColumn(
        "recovered", frames.box_grid_roundtrip(F.col("box"), target, original)
    )
    return recovered.withColumn(
        "residuals",
        frames.roundtrip_residuals(F.col("box"), F.col("recovered"), target, original),
    )


def roundtrip_gate_summary(audited: DataFrame) -> DataFrame:
    """One row: boxes, passes, failures, the worst residual."""
    passed = F.col("residuals.gate_pass")
    return audited.agg(
        F.count("*").alias("n"),
        F.count_if(passed).alias("n_pass"),
        F.count_if(~passed).alias("n_fail"),
        F.max("residuals.max_residual_mm").alias("worst_mm"),
        F.bool_and(passed).alias("all_pass"),
    )
