"""Metric files, sweep files and training logs of detector runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.operators.quality import epoch_ordinal, parse_metrics
from voxlake.schemas import SWEEP_ENTRY
from voxlake.sources.files import read_documents

FOLD_IN_PATH = r"fold(\d+)"
PARAMETER_IN_PATH = r"/sweep_([^/.]*)[^/]*$"


def _fold_of(path: Column, fold_pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, fold_pattern, 1), F.lit("")).try_cast("int").alias("fold")


def _whole_files(spark: SparkSession, glob: str, fold_pattern: str) -> DataFrame:
    """(value, path, fold) of small documents, one file each."""
    return read_documents(spark, glob).select("value", "path", _fold_of(F.col("path"), fold_pattern))


def checked_documents(documents: DataFrame, kind: str) -> DataFrame:
    """``documents`` (value, ...) with ``parsed``, a map of ``kind``, and the ``reason`` to skip
    them (NULL: keep). Nothing is left out: a document that is no JSON object has its row here."""
    parsed = documents.withColumn("parsed", F.from_json("value", f"map<string,{kind}>"))
    bare = F.trim(F.coalesce("value", F.lit("")), F.lit(" \t\r\n"))
    reason = F.when(bare == "", "empty document").when(
        F.col("parsed").isNull() | ~bare.startswith("{"), "not a JSON object"
    )
    return parsed.withColumn("reason", reason)


def rejected(checked: DataFrame) -> DataFrame:
    """(path, fold, reason) of the documents that were not read."""
    return checked.where(F.col("reason").isNotNull()).select("path", "fold", "reason")


def metric_documents(documents: DataFrame) -> DataFrame:
    """(fold, metric, value) of JSON documents ``(fold, value)`` of string metrics."""
    good = checked_documents(documents, "string").where(F.col("reason").isNull())
    return parse_metrics(good.select("fold", F.explode("parsed").alias("metric", "val")))


def read_fold_metrics(
    spark: SparkSession, glob: str, fold_pattern: str = FOLD_IN_PATH
) -> DataFrame:
    """Metrics of one flat JSON file per fold; see ``fold_metric_rejects`` for damaged ones."""
    return metric_documents(_whole_files(spark, glob, fold_pattern))


def fold_metric_rejects(spark: SparkSession, glob: str, fold_pattern: str = FOLD_IN_PATH) -> DataFrame:
    """(path, fold, reason) of the metric files that ``read_fold_metrics`` cannot read."""
    return rejected(checked_documents(_whole_files(spark, glob, fold_pattern), "string"))


def parse_score_repr(text: Column) -> Column:
    """Map of a dictionary printed with single quotes and bare ``nan``; {} if malformed."""
    quoted = F.regexp_replace(text, r"\bnan\b", "NaN")
    parsed = F.from_json(
        quoted,
        "map<string,double>",
        {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"},
    )
    return F.coalesce(parsed, F.create_map().cast("map<string,double>"))


def sweep_documents(documents: DataFrame) -> DataFrame:
    """Sweep entries of JSON documents ``(fold, parameter, value)``, in document order."""
    good = checked_documents(documents, SWEEP_ENTRY.simpleString()).where(F.col("reason").isNull())
    rows = good.select("fold", "parameter", F.posexplode(F.map_entries("parsed")).alias("ordinal", "e"))
    return rows.select(
        "fold",
        "parameter",
        "ordinal",
        F.col("e.key").alias("label"),
        F.col("e.value.state").alias("state"),
        F.col("e.value.overwrite").alias("overwrite"),
        parse_score_repr(F.coalesce("e.value.scores", F.lit("{}"))).alias("scores"),
    )


def read_sweep(
    spark: SparkSession,
    glob: str,
    fold_pattern: str = FOLD_IN_PATH,
    parameter_pattern: str = PARAMETER_IN_PATH,
) -> DataFrame:
    """(fold, parameter, ordinal, label, state, overwrite, scores) of ``sweep_<parameter>.json``."""
    files = _whole_files(spark, glob, fold_pattern)
    return sweep_documents(files.withColumn("parameter", F.regexp_extract("path", parameter_pattern, 1)))


def sweep_rejects(spark: SparkSession, glob: str, fold_pattern: str = FOLD_IN_PATH) -> DataFrame:
    """(path, fold, reason) of the sweep files that ``read_sweep`` cannot read."""
    return rejected(checked_documents(_whole_files(spark, glob, fold_pattern), SWEEP_ENTRY.simpleString()))


def sweep_metric(sweep: DataFrame, metric: str = "FROC_score_IoU_0.10") -> DataFrame:
    """One metric of each sweep entry, ready for ``sweep_extremes``."""
    return sweep.select(
        "fold",
        "parameter",
        "ordinal",
        "label",
        F.try_element_at("scores", F.lit(metric)).alias("value"),
    )


def read_train_logs(
    spark: SparkSession, glob: str, fold_pattern: str = FOLD_IN_PATH
) -> DataFrame:
    """(fold, line_no, line) of every log, numbered from 0 in file order.

    Logs are read line by line in as many tasks as they have blocks. A line's number is its place
    in its block plus the lines of the blocks before, which one aggregate counts. The files of one
    fold follow one another in the order of their paths. Lines end with a line feed, which the last
    one may lack; blank lines are lines. Folds without a log are found by
    ``convergence_summary(expected_folds=...)``.
    """
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(glob, lineSep="\n").select(
        F.col("value").alias("line"),
        path.alias("_path"),
        block.alias("_block"),
        _fold_of(path, fold_pattern),
        # consecutive within a block, as one task reads it from its start to its end
        F.monotonically_increasing_id().alias("_at"),
    )
    earlier = Window.partitionBy("fold").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("fold", "_path", "_block")
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select("_path", "_block", (F.col("_before") - F.col("_first")).alias("_shift"))
    )
    return lines.join(blocks, ["_path", "_block"]).select(
        "fold", (F.col("_at") + F.col("_shift")).alias("line_no"), "line"
    )


def loss_curves(losses: DataFrame, folds: list[int]) -> DataFrame:
    """(epoch, fold0_train_loss, fold0_val_loss, ...) with NULL where a fold has no value."""
    numbered = epoch_ordinal(losses)
    columns = [
        F.max(F.when((F.col("fold") == f) & (F.col("kind") == kind), F.col("loss"))).alias(
            f"fold{f}_{kind}_loss"
        )
        for f in folds
        for kind in ("train", "val")
    ]
    return numbered.groupBy("epoch").agg(*columns)


def write_loss_curves(losses: DataFrame, path: str) -> bool:
    """CSV of the loss curves, one row per epoch; False, and no output, without data.

    The parts are in the order of epochs; as many are written as the sort makes.
    """
    folds = [r[0] for r in losses.select("fold").distinct().orderBy("fold").collect()]
    if losses.where(F.col("loss").isNotNull()).isEmpty():
        return False
    curves = loss_curves(losses, folds).orderBy("epoch")
    curves.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return True
