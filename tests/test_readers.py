"""Readers on real files: damaged documents, logs in blocks, headers; scorers with a schema."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from test_sources import header
from voxlake.operators import audits as A
from voxlake.operators.pooling import nearest_tile
from voxlake.plans import datasets as D
from voxlake.plans import ensembles as E
from voxlake.plans import reports as P
from voxlake.plans.scorers import BatchScorer
from voxlake.sources import detections as S
from voxlake.sources import files as FS
from voxlake.sources import reports as R

# logs ------------------------------------------------------------------------------------


def test_log_lines_are_numbered_across_blocks(spark, tmp_path):
    """One file is read by many tasks, blank lines and the last line included."""
    lines = [f"line {i}" if i % 7 else "" for i in range(5_000)]
    (tmp_path / "fold3").mkdir()
    (tmp_path / "fold3" / "train.log").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        log = R.read_train_logs(spark, f"{tmp_path}/fold*/train.log")
        splits = spark.read.text(f"{tmp_path}/fold3/train.log", lineSep="\n").rdd.getNumPartitions()
        rows = sorted((r["line_no"], r["line"], r["fold"]) for r in log.collect())
    finally:
        spark.conf.set(key, before)
    assert splits > 8
    assert rows == [(i, line, 3) for i, line in enumerate(lines)]


def test_a_log_in_parts_and_one_without_an_end(spark, tmp_path):
    for fold, parts in {0: ["a\nb\n", "\nc"], 1: ["x\r\ny"], 2: [""]}.items():
        (tmp_path / f"fold{fold}").mkdir()
        for k, text in enumerate(parts):
            (tmp_path / f"fold{fold}" / f"part-{k}.log").write_bytes(text.encode())
    rows = R.read_train_logs(spark, f"{tmp_path}/fold*/*.log").collect()
    assert sorted((r["fold"], r["line_no"], r["line"]) for r in rows) == [
        (0, 0, "a"), (0, 1, "b"), (0, 2, ""), (0, 3, "c"), (1, 0, "x\r"), (1, 1, "y")]


# damaged documents -----------------------------------------------------------------------


def test_damaged_metric_and_sweep_files_are_rejects(spark, tmp_path):
    good = {"mAP_IoU_0.10_0.50_0.05_MaxDet_100": "0.5"}
    texts = {0: json.dumps(good, indent=2), 1: json.dumps(good)[:-3], 2: "[1, 2]", 3: " \n", 4: "{}"}
    for k, text in texts.items():
        for name in ("val_results/results_boxes.json", "sweep/sweep_iou.json"):
            path = tmp_path / f"fold{k}" / name
            path.parent.mkdir(parents=True)
            path.write_text(text if "val" in name else text.replace('"0.5"', '{"state": "s", "overwrite": {}, "scores": "{}"}'))
    glob = f"{tmp_path}/fold*/val_results/*.json"
    assert [r["fold"] for r in R.read_fold_metrics(spark, glob).collect()] == [0]
    reasons = {1: "not a JSON object", 2: "not a JSON object", 3: "empty document"}
    assert {r["fold"]: r["reason"] for r in R.fold_metric_rejects(spark, glob).collect()} == reasons
    sweeps = f"{tmp_path}/fold*/sweep/sweep_*.json"
    assert [(r["fold"], r["parameter"]) for r in R.read_sweep(spark, sweeps).collect()] == [(0, "iou")]
    assert {r["fold"]: r["reason"] for r in R.sweep_rejects(spark, sweeps).collect()} == reasons
    for k in (0,):
        (tmp_path / f"fold{k}" / "train.log").write_text("x\n")
    report = P.quality_report(spark, str(tmp_path), 1)
    assert report["rejects"].count() == 6


def test_records_over_several_lines_and_torn_ones(spark, tmp_path):
    record = {"pred_boxes": [[0.0, 1.0, 4.0, 5.0, 2.0, 6.0]], "pred_scores": [0.9]}
    (tmp_path / "0001_boxes.json").write_text(json.dumps(record, indent=4))
    (tmp_path / "0002_boxes.json").write_text(json.dumps(record, indent=4)[:50])
    detections, scored, rejects = S.read_detections(spark, str(tmp_path))
    assert [r["case_id"] for r in detections.collect()] == [1]
    assert {r["case_id"]: r["n_detections"] for r in scored.collect()} == {1: 1}
    assert [(r["path"][-15:], r["reason"]) for r in rejects.collect()] == [("0002_boxes.json", "not a JSON record")]


def test_packed_records(spark, tmp_path):
    box = [0.0, 1.0, 4.0, 5.0, 2.0, 6.0]
    lines = [{"name": "0007_boxes", "pred_boxes": [box, box], "pred_scores": [0.5, 0.25]},
             {"name": "x_boxes", "pred_boxes": [], "pred_scores": []}, {"name": "8_boxes", "pred_boxes": [box], "pred_scores": []}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"name": "9_bo\n')
    detections, scored, rejects = S.read_detections(spark, str(tmp_path), packed=True)
    assert sorted((r["case_id"], r["det_idx"], r["score"]) for r in detections.collect()) == [(7, 0, 0.5), (7, 1, 0.25)]
    assert scored.count() == 1
    assert sorted(r["reason"] for r in rejects.collect()) == [
        "boxes and scores differ in number", "name is not <digits>_boxes", "not a JSON record"]


# headers ---------------------------------------------------------------------------------


def test_many_headers_are_listed_by_tasks_and_read_by_few(spark, tmp_path, monkeypatch):
    """Tasks do not number as the files, and the driver's planner is not asked for names."""
    for k in range(1_500):
        (tmp_path / f"s{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"s{k % 3}" / f"DATA_{k}.nrrd").write_bytes(header())
    monkeypatch.setattr(FS.VolumeReader, "partitions", None)
    rows = FS.read_volumes(spark, str(tmp_path), partition_bytes=2 << 20)
    assert rows.rdd.getNumPartitions() <= FS.MANY_TASKS
    assert sorted(r.case_id for r in rows.select("case_id").collect()) == list(range(1_500))
    # the data source lists in its planner and gives the same rows
    monkeypatch.undo()
    spark.dataSource.register(FS.VolumeSource)
    source = spark.read.format("volume_headers").load(str(tmp_path))
    assert source.exceptAll(rows).isEmpty() and rows.exceptAll(source).isEmpty()
    assert FS.task_count(10_000_000, 10_000_000 << 20, 64 << 20) == 1_221
    assert FS.task_count(5, 5 << 20, 2 << 20) == 3 and FS.task_count(0, 0, 1) == 1


def test_header_source(spark, tmp_path):
    files = {
        "a/DATA_007.nrrd": header(), "a/b/MASK_7.nrrd": header(kind="float", directions=None),
        "DATA_8.nrrd": header(sizes="4 x 6"), "DATA_9.nrrd": b"\x00" * 10,
        "DATA_10.nrrd": header(origin="1,2"), "notes.txt": b"x", "DATA_x.nrrd": b"",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = FS.read_volumes(spark, str(tmp_path), partition_bytes=2 << 20)
    assert rows.rdd.getNumPartitions() > 2
    got = {(r["kind"], r["case_id"]): r for r in rows.collect()}
    assert {k: r["problem"] for k, r in got.items()} == {
        ("DATA", 7): None, ("MASK", 7): None, ("DATA", 8): "malformed sizes",
        ("DATA", 9): "malformed whole header", ("DATA", 10): "malformed space origin"}
    assert got["DATA", 7]["sizes"] == [4, 5, 6] and got["DATA", 7]["length"] == len(header())
    assert got["DATA", 8]["sizes"] is None and got["DATA", 8]["dtype"] == "uint8"
    assert got["MASK", 7]["directions"] is None and got["MASK", 7]["dtype"] == "float"
    (tmp_path / "empty").mkdir()
    assert FS.read_volumes(spark, str(tmp_path / "empty")).count() == 0
    # the rows are what the header rules take
    audit = {r["case_id"]: r["reason"] for r in A.header_audit(rows.where("kind = 'DATA'")).collect()}
    assert audit[7] is None and audit[8] is not None


# scorers ---------------------------------------------------------------------------------

SCHEMA = T.StructType().add("case_id", T.LongType()).add("score", T.DoubleType()).add("embedding", T.ArrayType(T.FloatType()))


def maker():
    # a function of its own travels to the workers, which cannot import this file
    def made(batch, **changes):
        columns = {
            "case_id": batch.column("case_id"),
            "score": pa.array([0.5] * len(batch)),
            "embedding": pa.array([[1.0, 2.0]] * len(batch), pa.list_(pa.float32())),
        }
        return pa.RecordBatch.from_pydict({k: v for k, v in {**columns, **changes}.items() if v is not None})

    return made


@pytest.fixture
def split(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(6)], "case_id bigint, fold int")


def test_batch_scorer(spark, split):
    made = maker()
    out = E.oof_candidates(1, BatchScorer(lambda bs: map(made, bs), SCHEMA, 2), split)
    assert sorted((r["case_id"], r["score"], r["source_detectors"]) for r in out.collect()) == [
        (1, 0.5, [1]), (3, 0.5, [1]), (5, 0.5, [1])]


@pytest.mark.parametrize("change, message", [
    (lambda n: {"score": None}, "column 'score' is missing"),
    (lambda n: {"extra": pa.array([1] * n)}, "column 'extra' is not declared"),
    (lambda n: {"score": pa.array([1] * n)}, "column 'score' is bigint, declared is double"),
    (lambda n: {"embedding": pa.array([[1.0]] * n, pa.list_(pa.float32()))}, "embedding must have 2 entries, got 1"),
    (lambda n: {"embedding": pa.array([None] * n, pa.list_(pa.float32()))}, "embedding must have 2 entries, got none"),
])
def test_batches_other_than_declared_fail(spark, split, tmp_path, change, message):
    made = maker()
    scorer = BatchScorer(lambda bs: (made(b, **change(len(b))) for b in bs), SCHEMA, 2)
    with pytest.raises(Exception, match=message):
        scorer(split).write.parquet(str(tmp_path / "out"))
    assert not list(tmp_path.glob("out/*.parquet"))


def test_frames_other_than_declared_fail(spark, split):
    def scorer(cases):
        return cases.withColumn("score", F.lit(1))

    with pytest.raises(ValueError, match="column 'score' is int, declared is double"):
        E.oof_candidates(1, scorer, split, schema=T.StructType([*SCHEMA.fields, T.StructField("x", T.IntegerType())]))
    with pytest.raises(ValueError, match="missing"):
        E.score_ensemble(lambda fold: scorer(split), range(2), "val", schema=SCHEMA)


# catalogs and tiles ----------------------------------------------------------------------


def test_a_case_without_truth_stays_in_the_plan(spark):
    rows = [("Train", k, f"{k}/{k}_{c}.nrrd") for k in ("DATA", "MASK") for c in (1, 2, 3)]
    files = A.with_case_ids(spark.createDataFrame(rows, "split string, kind string, path string"))
    truth = spark.createDataFrame([(1,), (3,), (3,)], "case_id long")
    plan = {r["case_id"]: (r["n_lesions"], r["rejected"], r["status"]) for r in D.catalog_dataset(files, truth).collect()}
    assert plan == {1: (1, False, "planned"), 2: (0, False, "no truth row"), 3: (2, True, "planned")}
    shapes = spark.createDataFrame([(r[2], [4, 5 if r[2] != "MASK/MASK_3.nrrd" else 6]) for r in rows], "path string, sizes array<long>")
    expected = spark.createDataFrame([("Train", 3)], "split string, n_expected long")
    problems = {(r["problem"], r["case_id"]) for r in D.catalog_problems(files, truth, expected, shapes).collect()}
    assert problems == {("no truth row", 2), ("shape differs", 3)}


def test_surplus_files(spark):
    rows = [("Train", "DATA", p) for p in ("a/DATA_1.nrrd", "b/DATA_1.nrrd", "c/DATA_001.nrrd", "a/DATA_2.nrrd")]
    files = A.with_case_ids(spark.createDataFrame(rows, "split string, kind string, path string"))
    assert sorted(r["path"] for r in A.surplus_files(files).collect()) == ["b/DATA_1.nrrd", "c/DATA_001.nrrd"]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_equal_boxes_keep_their_number(spark, block):
    box = (1, [0.0, 0.0, 2.0, 2.0, 0.0, 2.0])
    boxes = spark.createDataFrame([box, box, box, (2, [9.0] * 6)], "case_id long, slots array<double>")
    tiles = spark.createDataFrame(
        [(1, i, i, i, i) for i in range(7)], "case_id long, tile_idx int, o_d0 long, o_d1 long, o_d2 long")
    got = nearest_tile(boxes, tiles, (2, 2, 2), block=block).collect()
    assert sorted((r["case_id"], r["tile_idx"]) for r in got if r["case_id"] == 1) == [(1, 0)] * 3
    assert [r["tile_idx"] for r in got if r["case_id"] == 2] == [None]


def test_metric_files_are_listed_by_tasks(spark, tmp_path):
    for k in range(40):
        path = tmp_path / f"fold{k}" / "val_results" / "results_boxes.json"
        path.parent.mkdir(parents=True)
        path.write_text('{"mAP_IoU_0.10_0.50_0.05_MaxDet_100": "0.5"}' if k % 4 else "")
    (tmp_path / "fold_notes.txt").write_text("not a folder")
    (tmp_path / "fold99").mkdir()
    for glob in (f"{tmp_path}/fold*/val_results/results_boxes.json", f"file:{tmp_path}/fold*/val_*/*.json"):
        found = R.read_fold_metrics(spark, glob)
        # a file scan lists all files in the driver
        assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["fold"] for r in found.collect()) == [k for k in range(40) if k % 4]
        bad = {r["fold"]: r["reason"] for r in R.fold_metric_rejects(spark, glob).collect()}
        assert bad == {k: "empty document" for k in range(0, 40, 4)}
    with pytest.raises(FileNotFoundError):
        R.read_fold_metrics(spark, f"{tmp_path}/fold*/none/*.json")
