import hashlib
import json

import pytest
from pyspark.sql import functions as F

from voxlake.errors import ChecksumError, SourceError
from voxlake.operators import folds as folds_
from voxlake.plans import datasets as D
from voxlake.sources import manifests as M
from voxlake.sources import tables as T


@pytest.fixture(scope="module")
def cases(spark):
    # 42 benign and 58 malignant cases
    rows = [(i, "B" if i % 12 in (1, 2, 5, 7, 10) else "M") for i in range(1, 101)]
    frame = spark.createDataFrame(rows, "case_id long, label string")
    assert frame.where("label = 'B'").count() == 42
    return frame


@pytest.fixture(scope="module")
def split(cases):
    return folds_.stratified_folds(cases).cache()


def test_folds_partition_the_cases(split, cases):
    assert folds_.partition_check(split, cases).isEmpty()
    assert sorted(r["count"] for r in split.groupBy("fold").count().collect()) == [20] * 5


def test_per_class_counts_are_balanced(split):
    stats = folds_.fold_label_stats(split).collect()
    folds = [r for r in stats if not r["is_total"]]
    assert sorted(r["benign"] for r in folds) == [8, 8, 8, 9, 9]
    total = next(r for r in stats if r["is_total"])
    assert (total["benign"], total["malignant"], total["benign_fraction"]) == (42, 58, 0.42)
    assert folds_.degenerate_folds(split).where("degenerate").isEmpty()


def test_seed_decides_the_folds(split, cases):
    again = folds_.stratified_folds(cases.orderBy(F.desc("case_id")))
    assert folds_.set_diff(split, again, ["case_id", "fold"]).isEmpty()
    other = folds_.stratified_folds(cases, seed=43)
    assert not folds_.set_diff(split, other, ["case_id", "fold"]).isEmpty()


def test_train_and_oof_partition(split):
    for k in range(5):
        assert folds_.train_ids(split, k).intersect(folds_.oof_ids(split, k)).isEmpty()
        assert folds_.train_ids(split, k).count() + folds_.oof_ids(split, k).count() == 100
    with pytest.raises(ValueError):
        folds_.train_ids(split, 5)


def test_partition_check_names_the_fault(spark, split, cases):
    broken = split.where("case_id <> 3").union(
        spark.createDataFrame([(7, 4, "B"), (500, 0, "B")], "case_id long, fold int, label string")
    )
    found = {r["case_id"]: r["reason"] for r in folds_.partition_check(broken, cases).collect()}
    assert found == {3: "in no fold", 7: "in several folds", 500: "unknown case"}


def test_manifest_digest_is_canonical_json(spark, split, tmp_path):
    M.write_split_manifest(split, str(tmp_path / "m"), "v1")
    record = M.read_manifest_record(spark, str(tmp_path / "m")).first()
    ids = [sorted(r["case_id"] for r in split.where(f"fold = {k}").collect()) for k in range(5)]
    payload = json.dumps({"folds": ids, "seed": 42, "splitter_version": "v1"}, sort_keys=True, separators=(",", ":"))
    assert record["sha256"] == hashlib.sha256(payload.encode()).hexdigest()
    back = M.read_split_manifest(spark, str(tmp_path / "m"))
    assert folds_.set_diff(back, split, ["case_id", "fold", "label"]).isEmpty()
    text = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    assert text["global_bm"] == {"benign": 42, "benign_fraction": 0.42, "malignant": 58}
    assert len(text["bm_ratios_per_fold"]) == 5 and list(text) == sorted(text)


def test_edited_manifest_is_refused(spark, split, tmp_path):
    M.write_split_manifest(split, str(tmp_path / "m"), "v1")
    text = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    text["folds"][0][0], text["folds"][1][0] = text["folds"][1][0], text["folds"][0][0]
    (tmp_path / "bad.json").write_text(json.dumps(text))
    with pytest.raises(ChecksumError):
        M.read_split_manifest(spark, str(tmp_path / "bad.json"))


def test_large_splits_are_not_one_document(split, tmp_path):
    M.write_split_table(split, str(tmp_path / "t"))
    digests = split.sparkSession.read.parquet(str(tmp_path / "t" / "digests"))
    assert digests.agg(F.sum("n_cases")).first()[0] == 100


def test_verify_split(spark, cases, split, tmp_path):
    csv = tmp_path / "labels.csv"
    rows = cases.orderBy("case_id").collect()
    csv.write_text("case_id,label\n" + "".join(f"{r['case_id']},{r['label']}\n" for r in rows))
    digest = hashlib.sha256(csv.read_bytes()).hexdigest()
    M.write_split_manifest(split, str(tmp_path / "m"), "v1", csv_sha256=digest)
    assert D.verify_split(spark, str(csv), str(tmp_path / "m"))
    csv.write_text(csv.read_text().replace("\n1,B", "\n1,M"))
    with pytest.raises(ChecksumError, match="label file"):
        D.verify_split(spark, str(csv), str(tmp_path / "m"))
    M.write_split_manifest(folds_.stratified_folds(cases, seed=9), str(tmp_path / "n"), "v1", seed=42)
    with pytest.raises(ChecksumError, match="folds"):
        D.verify_split(spark, str(csv), str(tmp_path / "n"), expected=None)


def test_label_file_checks(spark, tmp_path):
    def write(text):
        path = tmp_path / "l.csv"
        path.write_text(text)
        return str(path)

    good = write("case_id,label\n7,B\n2,M\n")
    assert [tuple(r) for r in T.read_labels(spark, good, 2).collect()] == [(2, "M"), (7, "B")]
    with pytest.raises(SourceError, match="must hold"):
        T.read_labels(spark, good)
    with pytest.raises(SourceError, match="outside"):
        T.read_labels(spark, write("case_id,label\n7,X\n"), 1)
    with pytest.raises(SourceError, match="lacks columns"):
        T.read_labels(spark, write("case_id,kind\n7,B\n"), 1)


def test_roles_round_trip_and_faithfulness(spark, split, tmp_path):
    M.write_fold_roles(split, str(tmp_path / "roles"))
    produced = M.read_fold_roles(spark, str(tmp_path / "roles"))
    frozen = folds_.fold_roles(split)
    assert frozen.count() == 500
    assert folds_.split_faithfulness(produced, frozen).isEmpty()
    moved = folds_.fold_roles(split.withColumn("fold", F.expr("IF(case_id = 1, (fold + 1) % 5, fold)")))
    assert folds_.split_faithfulness(moved, frozen).count() == 4


def test_case_scope(spark, split):
    sizes = {r["split"]: r["count"] for r in folds_.case_scope(spark, split).groupBy("split").count().collect()}
    assert sizes == folds_.expected_scope_sizes()


def test_set_diff_is_one_aggregate_and_takes_nulls_as_equal(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "case_id BIGINT, role STRING")
    right = spark.createDataFrame([(2, "b"), (3, None), (None, "c")], "case_id BIGINT, role STRING")
    found = folds_.set_diff(left, right, ["case_id", "role"])
    assert sorted(map(tuple, found.collect())) == [(1, "a", "left"), (3, None, "right")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
