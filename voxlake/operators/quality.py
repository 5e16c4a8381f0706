"""Fold metrics, sweeps, training logs and run costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.text import (
    TRAIN_LABEL,
    TRAIN_MARK,
    VAL_LABEL,
    VAL_MARK,
    parse_signed_float,
)
from voxlake.operators.candidates import top_boxes
from voxlake.operators.ranking import first_rows, rank_in_buckets
from voxlake.schemas import EXPECTED_EPOCHS, GPU_HOUR_TRIGGER, METRICS, N_FOLDS

# --- metrics ----------------------------------------------------------------


def without_class_keys(metrics: DataFrame) -> DataFrame:
    """Drop the per-class duplicates of a metric (keys starting with ``0_``)."""
    return metrics.where(~F.col("metric").startswith("0_"))


def parse_metrics(metrics: DataFrame) -> DataFrame:
    """String metrics as doubles; "nan" becomes NaN, other text is dropped."""
    return (
        without_class_keys(metrics)
        .withColumn("value", F.col("val").try_cast("double"))
        .where(F.col("value").isNotNull())
        .drop("val")
    )


def is_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def is_finite(x: Column) -> Column:
    return is_number(x) & (F.abs(x) < F.lit(float("inf")))


def fold_metric_table(
    metrics: DataFrame, group: Sequence[str] = (), names: Sequence[str] = METRICS
) -> DataFrame:
    """Wide rows per fold plus a pooled row (fold NULL) per group.

    The pooled mean skips NaN; an absent metric is NaN. ``min_n_folds`` (pooled row
    only) is the smallest number of folds behind a metric that has any.
    """
    nan = F.lit(float("nan"))
    per_fold = metrics.groupBy(*group, "fold").agg(
        *[
            F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), nan).alias(n)
            for n in names
        ]
    )
    used = [F.count_if(is_number(F.col(f"`{n}`"))) for n in names]
    fewest = F.least(*[F.nullif(u, F.lit(0)) for u in used])
    pooled = per_fold.groupBy(*group).agg(
        F.coalesce(fewest, F.lit(0)).alias("min_n_folds"),
        *[
            F.coalesce(
                F.avg(F.when(is_number(F.col(f"`{n}`")), F.col(f"`{n}`"))), nan
            ).alias(n)
            for n in names
        ],
    )
    return with_pooled(per_fold, pooled)


def with_pooled(detail: DataFrame, pooled: DataFrame) -> DataFrame:
    """Detail rows and pooled rows in one table; columns of one side are NULL in the other."""
    return detail.unionByName(pooled, allowMissingColumns=True)


def sweep_extremes(sweep: DataFrame, keys: Sequence[str] = ("fold", "parameter")) -> DataFrame:
    """Best and worst label of each sweep: ``sweep(keys..., ordinal, label, value)``.

    Among equal values the first label is best and the last one worst.
    """
    place = F.struct((-F.col("value")).alias("down"), F.col("ordinal"))
    return sweep.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.min_by("label", place).alias("best_label"),
        F.max("value").alias("best_value"),
        F.max_by("label", place).alias("worst_label"),
        F.min("value").alias("worst_value"),
    )


def predictions_with_truth(predictions: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """Truth rows with their case's best ``n`` boxes; a case without any keeps one row."""
    best = top_boxes(predictions, n).select("case_id", "det_idx", "score", "box", "rank")
    return truth.join(best, "case_id", "left")


# --- training logs ----------------------------------------------------------


def loss_lines(log_lines: DataFrame) -> DataFrame:
    """Train and validation lines with their loss (NULL where the text has none)."""
    kind = F.when(F.col("line").contains(TRAIN_MARK), "train").when(
        F.col("line").contains(VAL_MARK), "val"
    )
    loss = F.when(F.col("kind") == "train", parse_signed_float(F.col("line"), TRAIN_LABEL)).otherwise(
        parse_signed_float(F.col("line"), VAL_LABEL)
    )
    return (
        log_lines.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("loss", loss)
        .drop("line")
    )


def epoch_ordinal(
    losses: DataFrame, keys: Sequence[str] = ("fold",), lines_per_bucket: int = 65_536
) -> DataFrame:
    """Loss values with their epoch: the n-th value of a kind belongs to epoch n."""
    return rank_in_buckets(
        losses.where(F.col("loss").isNotNull()),
        [*keys, "kind"],
        [F.col("line_no")],
        F.floor(F.col("line_no") / lines_per_bucket),
        "epoch",
    )


def convergence_summary(
    log_lines: DataFrame,
    expected_folds: DataFrame | None = None,
    keys: Sequence[str] = ("fold",),
    epochs: int = EXPECTED_EPOCHS,
) -> DataFrame:
    """Per fold: epochs, completeness, first and last losses, extraction errors.

    Scalars only, so a fold's log is combined on the map side. The ordered loss
    arrays are ``loss_arrays``; ``epoch_ordinal`` is their unbounded long form.
    ``expected_folds`` adds an error row for each fold without a log.
    """
    train, val = F.col("kind") == "train", F.col("kind") == "val"
    has_loss = F.col("loss").isNotNull()

    def at(pick, kind: Column) -> Column:
        return pick(F.when(kind & has_loss, F.col("loss")), F.when(kind & has_loss, F.col("line_no")))

    summary = loss_lines(log_lines).groupBy(*keys).agg(
        F.count_if(train).alias("epochs_completed"),
        F.count_if(train & has_loss).alias("n_train_loss"),
        F.count_if(val & has_loss).alias("n_val_loss"),
        at(F.min_by, train).alias("first_loss"),
        at(F.max_by, train).alias("final_loss"),
        at(F.max_by, val).alias("last_val_loss"),
    )
    seen = log_lines.select(*keys).distinct() if expected_folds is None else expected_folds
    if expected_folds is not None:
        logged = log_lines.select(*keys).distinct().withColumn("_logged", F.lit(True))
        seen = seen.join(logged, list(keys), "left")
    else:
        seen = seen.withColumn("_logged", F.lit(True))
    filled = seen.join(summary, list(keys), "left").fillna(
        0, ["epochs_completed", "n_train_loss", "n_val_loss"]
    )
    short = F.format_string(
        "train loss extracted for only %d/%d epochs", F.col("n_train_loss"), F.col("epochs_completed")
    )
    logged = F.coalesce("_logged", F.lit(False))
    return (
        filled.withColumn("training_complete", F.col("epochs_completed") == epochs)
        .withColumn(
            "loss_extraction_complete", logged & (F.col("n_train_loss") == F.col("epochs_completed"))
        )
        .withColumn(
            "error",
            F.when(~logged, F.lit("training log not found")).when(
                (F.col("epochs_completed") > 0)
                & (F.col("n_train_loss") < F.col("epochs_completed")),
                short,
            ),
        )
        .drop("_logged")
    )


def loss_arrays(losses: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Ordered train and validation losses per fold as arrays, one row per fold.

    ``epoch_ordinal`` has the same values in long form.
    """
    values = losses.where(F.col("loss").isNotNull())

    def ordered(kind: str) -> Column:
        row = F.when(F.col("kind") == kind, F.struct("line_no", "loss"))
        return F.transform(F.sort_array(F.collect_list(row)), lambda r: r["loss"])

    return values.groupBy(*keys).agg(
        ordered("train").alias("train_loss_per_epoch"), ordered("val").alias("val_loss_per_epoch")
    )


def monotone_check(
    losses: DataFrame, keys: Sequence[str] = ("fold",), kind: str = "train", window: int = 5
) -> DataFrame:
    """Per fold: is the mean of the last ``window`` losses below that of the first ones.

    Only ``window`` rows per fold and end leave a map task. Fewer than ``2 * window``
    values count as fine.
    """
    values = losses.where((F.col("kind") == kind) & F.col("loss").isNotNull())
    order = F.col("line_no")
    ends = [
        first_rows(values, keys, [o], window).groupBy(*keys).agg(F.avg("loss").alias(name))
        for o, name in ((order.asc(), "first_mean"), (order.desc(), "last_mean"))
    ]
    counts = values.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = counts.join(ends[0], list(keys)).join(ends[1], list(keys))
    return joined.withColumn(
        "monotone",
        (F.col("n") < 2 * window) | (F.col("last_mean") < F.col("first_mean")),
    )


def first_last_loss(losses: DataFrame, keys: Sequence[str] = ("fold", "kind")) -> DataFrame:
    values = losses.where(F.col("loss").isNotNull())
    return values.groupBy(*keys).agg(
        F.min_by("loss", "line_no").alias("first_loss"),
        F.max_by("loss", "line_no").alias("last_loss"),
    )


def convergence_status(
    summary: DataFrame,
    monotone: DataFrame,
    keys: Sequence[str] = ("fold",),
    epochs: int = EXPECTED_EPOCHS,
) -> DataFrame:
    """Summary rows with a monotone flag, the expected epochs and a status code.

    The code is ``COMPLETE``, ``INCOMPLETE`` or ``ERROR``; ``error`` holds the whole message.
    """
    status = (
        F.when(F.col("error").isNotNull(), "ERROR")
        .when(~F.col("training_complete"), "INCOMPLETE")
        .otherwise("COMPLETE")
    )
    flags = monotone.select(*keys, "monotone")
    return (
        summary.join(flags, list(keys), "left")
        .withColumn("monotone", F.coalesce("monotone", F.lit(True)))
        .withColumn("epochs_expected", F.lit(epochs))
        .withColumn("status", status)
    )


def all_complete(status: DataFrame) -> DataFrame:
    return status.agg(F.bool_and(F.col("status") == "COMPLETE").alias("all_complete"))


# --- run cost ---------------------------------------------------------------


def run_cost(
    runs: DataFrame,
    group: Sequence[str] = (),
    trigger: float = GPU_HOUR_TRIGGER,
    n_folds: int = N_FOLDS,
) -> DataFrame:
    """Total GPU hours and the extrapolation from fold 0, against the trigger."""
    first = F.max(F.when(F.col("fold") == 0, F.col("gpu_hours")))
    return (
        runs.groupBy(*group)
        .agg(
            F.count("*").alias("n_runs"),
            F.sum("gpu_hours").alias("total_gpu_hours"),
            (first * n_folds).alias("extrapolated_gpu_hours"),
        )
        .withColumn(
            "exceeded", F.coalesce(F.col("extrapolated_gpu_hours") > trigger, F.lit(False))
        )
    )


def epoch_rate_cost(
    rate: Column, epochs: Column, trigger: float = GPU_HOUR_TRIGGER, n_folds: int = N_FOLDS
) -> Column:
    """Extrapolation from a measured rate: struct of hours and trigger flag."""
    hours = rate * epochs * n_folds
    return F.struct(hours.alias("gpu_hours"), (hours > trigger).alias("exceeded"))
