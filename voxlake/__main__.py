"""Command line: ``python -m voxlake <command>``; exit code 1 on a failed check."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from voxlake import errors
from voxlake.operators import audits, folds
from voxlake.operators.candidates import require_provenance
from voxlake.plans import datasets, reports
from voxlake.schemas import EMBEDDING_DIM, N_FOLDS, SPLIT_SEED
from voxlake.sources import files, manifests, tables

FAILURES = (
    errors.SourceError,
    errors.ProvenanceError,
    errors.ChecksumError,
    errors.HeaderError,
    errors.DatasetError,
)


def make_split(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = tables.read_labels(spark, a.labels, a.expected)
    split = folds.stratified_folds(cases, a.folds, a.seed)
    digest = manifests.file_digest(spark, a.labels).first()["sha256"]
    manifests.write_split_manifest(split, a.manifest, a.version, a.seed, digest)
    folds.degenerate_folds(split).orderBy("fold").show(a.folds)


def verify_split(spark: SparkSession, a: argparse.Namespace) -> None:
    datasets.verify_split(spark, a.labels, a.manifest, a.expected)
    print("split verified")


def quality(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, table in reports.quality_report(spark, a.root, a.folds, a.loss_csv).items():
        print(name)
        table.show(100, truncate=False)


def candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_candidates(spark, a.candidates)
    membership = manifests.read_split_manifest(spark, a.manifest)
    print(f"{require_provenance(rows, membership, a.strict)} candidates checked")
    report = reports.candidate_report(rows, membership, a.dim)
    report["summary"].show(truncate=False)
    if "gap" in report and a.gap_report:
        manifests.write_gap_report(report["gap"], a.gap_report)


def headers(spark: SparkSession, a: argparse.Namespace) -> None:
    found = files.read_headers(files.discover_files(spark, a.root))
    audits.header_audit_report(found).show()
    audits.require_headers(found)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxlake")
    commands = top.add_subparsers(required=True)

    def command(fn, *names: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(fn.__name__.replace("_", "-"))
        sub.set_defaults(run=fn)
        for name in names:
            sub.add_argument(name)
        return sub

    for fn in (make_split, verify_split):
        sub = command(fn, "labels", "manifest")
        sub.add_argument("--expected", type=int, default=100)
        if fn is make_split:
            sub.add_argument("--folds", type=int, default=N_FOLDS)
            sub.add_argument("--seed", type=int, default=SPLIT_SEED)
            sub.add_argument("--version", default="v1")
    sub = command(quality, "root")
    sub.add_argument("--folds", type=int, default=N_FOLDS)
    sub.add_argument("--loss-csv")
    sub = command(candidates, "candidates", "manifest")
    sub.add_argument("--dim", type=int, default=EMBEDDING_DIM)
    sub.add_argument("--strict", action="store_true")
    sub.add_argument("--gap-report")
    command(headers, "root")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("voxlake").getOrCreate()
    try:
        args.run(spark, args)
    except FAILURES as exc:
        print(f"{type(exc).__name__}: {exc}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
