"""Per-case detection records in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.text import detection_case_id
from voxlake.schemas import DETECTION_RECORD


DAMAGED = "_damaged"


def landing_records(
    spark: SparkSession, landing: str, stream: bool = False, packed: bool = False, names: str | None = None
) -> DataFrame:
    """One row per JSON record with its path; what is no record has its text in ``_damaged``.

    A record is a file ``<digits>_boxes.json``, over as many lines as it likes. ``packed`` files
    (``*.jsonl``, or what the pattern ``names`` says) hold a record on each line, with its ``name``
    in place of the file's.
    """
    schema = T.StructType([*DETECTION_RECORD.fields, *([T.StructField("name", T.StringType())] if packed else [])])
    reader = spark.readStream if stream else spark.read
    records = (
        reader.schema(schema.add(DAMAGED, T.StringType()))
        .option("columnNameOfCorruptRecord", DAMAGED)
        .option("multiLine", not packed)
        .option("pathGlobFilter", names or ("*.jsonl" if packed else "*_boxes.json"))
        .json(landing)
    )
    return records.select("*", F.col("_metadata.file_path").alias("path"))


def checked_records(records: DataFrame) -> DataFrame:
    """Records with ``case_id`` and the ``reason`` to skip them (NULL: keep)."""
    damaged = F.col(DAMAGED).isNotNull() if DAMAGED in records.columns else F.lit(False)
    name = F.col("name") if "name" in records.columns else F.col("path")
    reason = (
        F.when(damaged, "not a JSON record")
        .when(F.col("case_id").isNull(), "name is not <digits>_boxes")
        .when(F.col("pred_boxes").isNull(), "no pred_boxes")
        .when(F.col("pred_scores").isNull(), "no pred_scores")
        .when(
            ~F.forall("pred_boxes", lambda b: F.coalesce(F.size(b) == 6, F.lit(False))),
            "boxes are not N x 6",
        )
        .when(F.size("pred_boxes") != F.size("pred_scores"), "boxes and scores differ in number")
    )
    return records.withColumn("case_id", detection_case_id(name)).withColumn("reason", reason)


def explode_records(checked: DataFrame) -> DataFrame:
    """(case_id, det_idx, slots, score): one row per detection, in record order."""
    paired = F.arrays_zip(F.col("pred_boxes").alias("slots"), F.col("pred_scores").alias("score"))
    return (
        checked.where(F.col("reason").isNull())
        .select("case_id", F.posexplode(paired).alias("det_idx", "d"))
        .select(
            "case_id",
            F.col("det_idx").cast("bigint").alias("det_idx"),
            F.col("d.slots").cast("array<double>").alias("slots"),
            F.col("d.score").cast("double").alias("score"),
        )
    )


def read_detections(
    spark: SparkSession, landing: str, packed: bool = False, names: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, scored cases, rejects). A record with no boxes is a scored case."""
    checked = checked_records(landing_records(spark, landing, packed=packed, names=names))
    scored = checked.where(F.col("reason").isNull()).select(
        "case_id", F.size("pred_boxes").alias("n_detections")
    )
    rejects = checked.where(F.col("reason").isNotNull()).select("path", "reason")
    return explode_records(checked), scored, rejects
