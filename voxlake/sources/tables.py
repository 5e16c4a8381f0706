"""Label, truth-box and candidate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.errors import SourceError
from voxlake.functions.frames import csv_columns, csv_to_box
from voxlake.operators.folds import missing_columns
from voxlake.schemas import CANDIDATE, LABELS, TRUTH_ROW


def read_typed_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with a header, all columns as text plus ``row_no``; required columns must exist.

    ``row_no`` orders the rows of a file as they stand in it: block start, then
    position within the block, whatever the split into tasks.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = missing_columns(required, raw.columns)
    if missing:
        raise SourceError(f"{path} lacks columns {missing}; found {raw.columns}")
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns], position.alias("row_no"))


def read_labels(spark: SparkSession, path: str, expected: int | None = 100) -> DataFrame:
    """(case_id, label) sorted by case, after checks of columns, count and label domain."""
    rows = read_typed_csv(spark, path, ("case_id", "label")).select(
        F.col("case_id").cast("bigint"), "label"
    )
    checks = rows.agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).alias("bad"),
    ).first()
    if expected is not None and checks["n"] != expected:
        raise SourceError(f"{path} must hold {expected} cases, found {checks['n']}")
    if checks["bad"]:
        raise SourceError(f"{path} holds {checks['bad']} labels outside {list(LABELS)}")
    return rows.orderBy("case_id")


def keep_row(df: DataFrame, keys: Sequence[str], which: str) -> DataFrame:
    """First or last row per key by ``row_no``; one map-side-combined aggregate."""
    pick = {"first": F.min_by, "last": F.max_by}[which]
    rest = [c for c in df.columns if c not in (*keys, "row_no")]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.col("row_no")).alias("_row"))
        .select(*keys, "_row.*")
    )


def read_truth_rows(spark: SparkSession, path: str) -> DataFrame:
    """Typed center/size rows ``(case_id, c_*, len_*, row_no)``."""
    raw = read_typed_csv(spark, path, TRUTH_ROW.fieldNames())
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TRUTH_ROW.fields]
    return raw.select(*typed, "row_no").withColumnRenamed("id", "case_id")


def read_truth_boxes(spark: SparkSession, path: str, duplicates: str = "last") -> DataFrame:
    """(case_id, box): of several rows per case the last, the first, or all."""
    if duplicates not in ("last", "first", "all"):
        raise ValueError(f"duplicates must be last, first or all, got {duplicates!r}")
    rows = read_truth_rows(spark, path)
    if duplicates != "all":
        rows = keep_row(rows, ["case_id"], duplicates)
    center, size = csv_columns()
    return rows.select("case_id", csv_to_box(center, size).alias("box"))


def write_candidates(candidates: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per split; ragged source lists stay arrays."""
    candidates.write.mode(mode).partitionBy("split").parquet(path)


def read_candidates(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Candidates of one split (other folders are not listed into the scan) or of all."""
    columns = CANDIDATE.fieldNames()
    found = spark.read.parquet(path)
    if split is not None:
        found = found.where(F.col("split") == split)
    return found.select(
        *[c for c in columns if c in found.columns], *[c for c in found.columns if c not in columns]
    )
