"""Quality and candidate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import candidates as C
from voxlake.operators import quality as Q
from voxlake.errors import SourceError
from voxlake.schemas import N_FOLDS
from voxlake.sources import reports as R


def quality_report(
    spark: SparkSession,
    root: str,
    n_folds: int = N_FOLDS,
    loss_csv: str | None = None,
) -> dict[str, DataFrame]:
    """Metric table, sweep extremes and convergence of the runs below ``root``.

    Layout: ``fold<k>/val_results/results_boxes.json``, ``fold<k>/sweep/sweep_*.json``
    and ``fold<k>/train.log``. A fold without metrics is an error; one without a log has a
    status that says so. ``rejects`` has the path and the reason of each damaged file.
    """
    metric_files = f"{root}/fold*/val_results/results_boxes.json"
    metrics = R.read_fold_metrics(spark, metric_files)
    missing = sorted(set(range(n_folds)) - {r[0] for r in metrics.select("fold").distinct().collect()})
    if missing:
        raise SourceError(f"no metric file for folds {missing} below {root}")
    sweep_files = f"{root}/fold*/sweep/sweep_*.json"
    sweep = R.sweep_metric(R.read_sweep(spark, sweep_files))
    lines = R.read_train_logs(spark, f"{root}/fold*/train.log")
    losses = Q.loss_lines(lines)
    expected = spark.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    status = Q.convergence_status(
        Q.convergence_summary(lines, expected), Q.monotone_check(losses)
    )
    if loss_csv is not None:
        R.write_loss_curves(losses, loss_csv)
    return {
        "metrics": Q.fold_metric_table(metrics),
        "sweep": Q.sweep_extremes(sweep),
        "convergence": status,
        "all_complete": Q.all_complete(status),
        "rejects": R.fold_metric_rejects(spark, metric_files).unionByName(R.sweep_rejects(spark, sweep_files)),
    }


def candidate_report(
    candidates: DataFrame, membership: DataFrame, dim: int
) -> dict[str, DataFrame]:
    """Provenance, summary and train-versus-ensemble variance gap.

    The gap compares train with the first of val and test that has candidates.
    """
    present = {r[0] for r in candidates.select("split").distinct().collect()}
    other = next((s for s in ("val", "test") if s in present), None)
    out = {
        "provenance": C.provenance_report(candidates, membership),
        "summary": C.candidate_summary(candidates, dim),
    }
    if "train" in present and other is not None:
        out["gap"] = C.embedding_variance_gap(
            candidates.where("split = 'train'"), candidates.where(F.col("split") == other), dim
        )
    return out
