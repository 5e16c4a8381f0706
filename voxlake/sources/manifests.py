"""Split manifests and the other one-document JSON sinks.

A document describes one dataset and is small by definition. The builders take
``keys`` and write one document per dataset, so many datasets make many documents,
never a larger one. Writers check the largest document first and refuse splits that
belong in ``write_split_table``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.errors import ChecksumError
from voxlake.operators import folds as folds_
from voxlake.schemas import MANIFEST, N_FOLDS, SPLIT_SEED
from voxlake.sources.files import open_path


def _write_documents(documents: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Text, one document per line; a single document is a single file."""
    lines = documents.select("value")
    (lines if keys else lines.coalesce(1)).write.mode("overwrite").text(path)


def _digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for uri in batch["path"]:
            digest = hashlib.sha256()
            with open_path(uri) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": digests})


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file's raw bytes, streamed, so a file may be of any size."""
    listed = spark.read.format("binaryFile").load(path).select("path")
    return listed.mapInPandas(_digest_batches, "path string, sha256 string")


def read_manifest_record(
    spark: SparkSession, path: str, verify: bool = True, lines: bool = False
) -> DataFrame:
    """One row per manifest; digests are recomputed and compared.

    ``lines`` reads many one-line documents, otherwise a file is one document.
    """
    record = spark.read.option("multiLine", not lines).schema(MANIFEST).json(path)
    if verify:
        digest = folds_.manifest_digest(F.col("folds"), F.col("seed"), F.col("splitter_version"))
        same = F.coalesce(F.col("sha256") == digest, F.lit(False))
        found = record.agg(F.count("*").alias("n"), F.count_if(~same).alias("bad")).first()
        if found["bad"] or not found["n"]:
            raise ChecksumError(
                f"manifest {path}: {found['bad']} of {found['n']} documents differ from their sha256"
            )
    return record


def manifest_split(record: DataFrame) -> DataFrame:
    """(case_id, fold, label) of a manifest row."""
    members = record.select("label_of", F.posexplode("folds").alias("fold", "ids")).select(
        "label_of", "fold", F.explode("ids").alias("case_id")
    )
    label = F.try_element_at("label_of", F.col("case_id").cast("string"))
    return members.select("case_id", "fold", label.alias("label"))


def read_split_manifest(
    spark: SparkSession, path: str, verify: bool = True, lines: bool = False
) -> DataFrame:
    return manifest_split(read_manifest_record(spark, path, verify, lines))


def manifest_documents(
    split: DataFrame,
    version: str,
    seed: int = SPLIT_SEED,
    csv_sha256: str = "unknown",
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys..., value): one manifest per dataset as key-sorted JSON."""
    label = F.struct(F.col("case_id").cast("string").alias("k"), F.col("label").alias("v"))
    per_fold = split.groupBy(*keys, "fold").agg(
        F.array_sort(F.collect_list("case_id")).alias("ids"),
        F.collect_list(label).alias("labels"),
        F.count_if(F.col("label") == "B").alias("benign"),
        F.count("*").alias("n"),
    )
    entry = F.struct("fold", "ids", "labels", "benign", "n")
    dataset = per_fold.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("f"),
        F.sum("benign").alias("benign"),
        F.sum("n").alias("n"),
    )

    def ratio(benign, n):
        return F.struct(
            benign.alias("benign"),
            (benign / n).alias("benign_fraction"),
            (n - benign).alias("malignant"),
        )

    folds = F.transform("f", lambda x: x["ids"])
    digest = folds_.manifest_digest(F.col("folds"), F.lit(seed).cast("bigint"), F.lit(version))
    document = F.struct(
        F.transform("f", lambda x: ratio(x["benign"], x["n"])).alias("bm_ratios_per_fold"),
        "folds",
        ratio(F.col("benign"), F.col("n")).alias("global_bm"),
        F.map_from_entries(
            F.array_sort(F.flatten(F.transform("f", lambda x: x["labels"])))
        ).alias("label_of"),
        F.lit(csv_sha256).alias("labels_csv_sha256"),
        F.size("folds").alias("n_folds"),
        F.lit(seed).alias("seed"),
        digest.alias("sha256"),
        F.lit(version).alias("splitter_version"),
    )
    return dataset.withColumn("folds", folds).select(*keys, F.to_json(document).alias("value"))


def write_split_manifest(
    split: DataFrame,
    path: str,
    version: str,
    seed: int = SPLIT_SEED,
    csv_sha256: str = "unknown",
    keys: Sequence[str] = (),
) -> None:
    _write_documents(manifest_documents(split, version, seed, csv_sha256, keys), path, keys)


def write_split_table(split: DataFrame, path: str) -> None:
    """The split as Parquet plus its block digests; a document holds a dataset in one row."""
    split.write.mode("overwrite").partitionBy("fold").parquet(f"{path}/split")
    folds_.split_digests(split).write.mode("overwrite").parquet(f"{path}/digests")


def fold_roles_documents(
    split: DataFrame, k: int = N_FOLDS, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys..., value): ``[{"train": [...], "val": [...]}, ...]`` in fold order."""
    roles = folds_.fold_roles(split, k, keys)

    def ids(role: str):
        return F.array_sort(
            F.collect_list(F.when(F.col("role") == role, F.col("case_id")))
        ).alias(role)

    per_fold = roles.groupBy(*keys, "fold").agg(ids("train"), ids("val"))
    ordered = F.array_sort(F.collect_list(F.struct("fold", F.struct("train", "val").alias("r"))))
    return per_fold.groupBy(*keys).agg(
        F.to_json(F.transform(ordered, lambda f: f["r"])).alias("value")
    )


def write_fold_roles(
    split: DataFrame,
    path: str,
    k: int = N_FOLDS,
    keys: Sequence[str] = (),
) -> None:
    """Roles of the split as given; folds are never derived again here."""
    _write_documents(fold_roles_documents(split, k, keys), path, keys)


def write_roles_table(split: DataFrame, path: str, k: int = N_FOLDS) -> None:
    """Fold roles in long form, for splits that are too large for one document."""
    roles = folds_.fold_roles(split, k)
    roles.write.mode("overwrite").partitionBy("fold", "role").parquet(path)


def read_fold_roles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(fold, role, case_id) of role documents."""
    text = spark.read.text(path, wholetext=not lines)
    parsed = F.from_json("value", "array<struct<train: array<bigint>, val: array<bigint>>>")
    entries = text.select(F.posexplode(parsed).alias("fold", "e"))
    roles = F.array(
        F.struct(F.lit("train").alias("role"), F.col("e.train").alias("ids")),
        F.struct(F.lit("val").alias("role"), F.col("e.val").alias("ids")),
    )
    return entries.select("fold", F.explode(roles).alias("r")).select(
        "fold", F.col("r.role").alias("role"), F.explode("r.ids").alias("case_id")
    )


def gap_report_document(gap: DataFrame) -> DataFrame:
    """One row ``value`` with the three numbers of a variance gap."""
    finite = ~F.isnan("ratio") & (F.abs("ratio") < F.lit(float("inf")))
    numbers = gap.agg(
        F.coalesce(F.avg(F.when(finite, F.col("ratio"))), F.lit(float("nan"))).alias(
            "pooled_mean_ratio"
        ),
        F.avg("oof_var").alias("per_dim_oof_var_mean"),
        F.avg("ens_var").alias("per_dim_ensemble_var_mean"),
    )
    return numbers.select(F.to_json(F.struct("*")).alias("value"))


def write_gap_report(gap: DataFrame, path: str) -> None:
    _write_documents(gap_report_document(gap), path)


def run_summary_documents(
    runs: DataFrame, commit: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys..., value): the fold runs of a campaign and their total."""
    fields = F.struct(
        "fold",
        "checkpoint_path",
        "wall_clock_hours",
        "gpu_hours",
        "final_val_metric",
        "detector_commit",
    )
    rows = runs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(fields)).alias("folds"),
        F.sum("gpu_hours").alias("total_gpu_hours"),
        F.lit(commit).alias("detector_commit"),
    )
    document = F.struct("folds", "total_gpu_hours", "detector_commit")
    return rows.select(*keys, F.to_json(document).alias("value"))


def write_run_summary(
    runs: DataFrame,
    path: str,
    commit: str | None = None,
    keys: Sequence[str] = (),
) -> None:
    _write_documents(run_summary_documents(runs, commit, keys), path, keys)
