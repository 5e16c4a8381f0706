import json

import pytest
from pyspark.sql import functions as F

from voxlake.errors import DatasetError, HeaderError, SourceError
from voxlake.operators import audits as A
from voxlake.operators import quality as Q
from voxlake.plans import datasets as D
from voxlake.plans import reports as P
from voxlake.sources import detections as S
from voxlake.sources import files as FS
from voxlake.sources import manifests as M
from voxlake.sources import reports as R
from voxlake.sources import tables as T
from voxlake.streaming import landing as L

TRUTH = "id,c_x,c_y,c_z,len_x,len_y,len_z\n"


def test_truth_duplicates(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text(TRUTH + "5,3,3,3,2,2,2\n9,3,3,3,4,4,4\n5,13,13,13,2,2,2\n")
    for mode, low in (("last", 12), ("first", 2)):
        boxes = {r["case_id"]: r["box"] for r in T.read_truth_boxes(spark, str(path), mode).collect()}
        assert boxes[5]["min_d0"] == low and len(boxes) == 2
    assert T.read_truth_boxes(spark, str(path), "all").count() == 3
    path.write_text("id,c_x\n1,2\n")
    with pytest.raises(SourceError):
        T.read_truth_boxes(spark, str(path))


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    box = [0.0, 1.0, 4.0, 5.0, 2.0, 6.0]
    records = {
        "0042_boxes": {"pred_boxes": [box, box, [9.0, 1.0, 2.0, 5.0, 2.0, 6.0]], "pred_scores": [0.9, 0.5, 0.1]},
        "0007_boxes": {"pred_boxes": [], "pred_scores": []},
        "0008_boxes": {"pred_scores": [0.5]},
        "0009_boxes": {"pred_boxes": [[1.0, 2.0]], "pred_scores": [0.5]},
        "x10_boxes": {"pred_boxes": [box], "pred_scores": [0.5]},
    }
    for name, record in records.items():
        (folder / f"{name}.json").write_text(json.dumps(record))
    (folder / "other.json").write_text("{}")
    return str(folder)


def test_landing_folder(spark, landing):
    detections, scored, rejects = S.read_detections(spark, landing)
    assert [(r["case_id"], r["det_idx"]) for r in detections.orderBy("det_idx").collect()] == [(42, 0), (42, 1), (42, 2)]
    assert {r["case_id"]: r["n_detections"] for r in scored.collect()} == {42: 3, 7: 0}
    assert sorted(r["reason"] for r in rejects.collect()) == [
        "boxes are not N x 6", "name is not <digits>_boxes", "no pred_boxes"]


def test_landing_stream_equals_batch(spark, landing, tmp_path):
    rows = L.stream_detections(spark, landing)
    assert rows.isStreaming
    L.append_detections(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("det_idx").collect()
    assert [(r["case_id"], r["det_idx"], tuple(r["box"])) for r in out] == [
        (42, 0, (0, 1, 2, 4, 5, 6)), (42, 1, (0, 1, 2, 4, 5, 6))]


def header(sizes="4 5 6", directions="(1,0,0) (0,1,0) (0,0,1)", origin="(0,0,0)", kind="uchar"):
    lines = ["NRRD0004", "# made for a test", f"type: {kind}", f"dimension: {len(sizes.split())}", f"sizes: {sizes}"]
    lines += [f"space directions: {directions}"] if directions else []
    lines += [f"space origin: {origin}"] if origin else []
    return ("\n".join([*lines, "encoding: raw"]) + "\n\n").encode() + bytes(200)


def test_file_discovery_and_headers(spark, tmp_path):
    root = tmp_path / "tree"
    for name, payload in {
        "DATA/a/DATA_007.nrrd": header(),
        "DATA/b/DATA_12.nrrd": header(directions="(0.5,0,0) (0,0.5,0) (0,0,0.5)"),
        "MASK/MASK_0007.nrrd": header(origin="(1,0,0)"),
        "MASK/MASK_0012.nrrd": header(directions=None, kind="float"),
        "MASK/notes.txt": b"x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(payload)
    found = FS.discover_files(spark, str(root))
    assert sorted((r["kind"], r["case_id"]) for r in found.collect()) == [
        ("DATA", 7), ("DATA", 12), ("MASK", 7), ("MASK", 12)]
    headers = FS.read_headers(found)
    audit = {r["path"].split("/")[-1]: r["reason"] for r in A.header_audit(headers).collect()}
    assert audit == {"DATA_007.nrrd": None, "DATA_12.nrrd": "directions not identity",
                     "MASK_0007.nrrd": "origin not zero", "MASK_0012.nrrd": "no directions"}
    good = headers.where("path LIKE '%DATA_007%'")
    assert good.first()["sizes"] == [4, 5, 6] and good.first()["dtype"] == "uint8"
    A.require_headers(good, F.array(*[F.lit(n).cast("bigint") for n in (4, 5, 6)]))
    with pytest.raises(HeaderError):
        A.require_headers(headers)
    assert A.header_audit(good, F.array(F.lit(1).cast("bigint"))).first()["reason"] == "sizes differ from shape"
    assert headers.where(A.dtype_problem().isNotNull()).count() == 1
    digests = M.file_digest(spark, str(root / "DATA/a"))
    assert len(digests.first()["sha256"]) == 64


def numbered(spark, rows):
    frame = spark.createDataFrame(rows, "split string, kind string, path string")
    return A.with_case_ids(frame)


def test_catalog_rules(spark):
    files = numbered(spark, [
        ("Train", "DATA", "t/DATA_1.nrrd"), ("Train", "MASK", "t/MASK_0001.nrrd"),
        ("Train", "DATA", "t/DATA_2.nrrd"), ("Train", "DATA", "u/DATA_002.nrrd"),
        ("Test", "MASK", "s/MASK_9.nrrd"),
    ])
    truth = spark.createDataFrame([(1,), (1,)], "case_id long")
    expected = spark.createDataFrame([("Train", 2), ("Test", 1)], "split string, n_expected long")
    problems = {(r["problem"], r["case_id"]) for r in D.catalog_problems(files, truth, expected).collect()}
    assert problems == {("duplicate file", 2), ("missing mask", 2), ("no truth row", 2), ("case count", None)}
    plan = D.catalog_dataset(files, truth).collect()
    assert [(p["image"], p["label"], p["sidecar"], p["rejected"]) for p in plan] == [
        ("0001_0000.nii.gz", "0001.nii.gz", "0001.json", True)]
    assert {r["status"] for r in A.pair_volume_mask(files).collect()} == {"paired", "missing mask", "extra mask"}
    with pytest.raises(DatasetError, match="more than one"):
        A.require_single_lesions(truth)
    with pytest.raises(DatasetError, match="no truth"):
        A.require_single_lesions(truth.limit(0))


def test_dataset_verification(spark):
    record = spark.createDataFrame([({k: "1" for k in ("task", "dim", "modalities", "labels", "test_labels")},)], "fields map<string,string>")
    roles = spark.createDataFrame([(0, "val", 1), (1, "train", 1)], "fold int, role string, case_id long")
    labels = spark.createDataFrame([("l/0001.nii.gz",)], "path string")
    sidecars = spark.createDataFrame([("l/0001.json",)], "path string")
    images = spark.createDataFrame([("i/1", [0.3, 0.3, 0.5])], "path string, spacing array<double>")
    D.verify_dataset(record, roles, roles, labels, sidecars, images.limit(0))
    D.verify_dataset(record, roles, roles, labels, sidecars, images)
    bad = spark.createDataFrame([("i/1", [0.3, 0.3, 0.50001])], "path string, spacing array<double>")
    with pytest.raises(DatasetError, match="spacing"):
        D.verify_dataset(record, roles, roles, labels, sidecars, bad)
    with pytest.raises(DatasetError, match="sidecars"):
        D.verify_dataset(record, roles, roles, labels, sidecars.limit(0), images)
    with pytest.raises(DatasetError, match="fold count"):
        D.verify_dataset(record, roles.where("fold = 0"), roles, labels, sidecars, images)


@pytest.fixture
def runs(tmp_path):
    for k in range(2):
        fold = tmp_path / f"fold{k}"
        (fold / "val_results").mkdir(parents=True)
        (fold / "sweep").mkdir()
        metrics = {"FROC_score_IoU_0.10": str(0.5 + k / 10), "mAP_IoU_0.10_0.50_0.05_MaxDet_100": "nan" if k else "0.2",
                   "0_FROC_score_IoU_0.10": "9", "AP_IoU_0.10_MaxDet_100": "text"}
        (fold / "val_results" / "results_boxes.json").write_text(json.dumps(metrics))
        sweep = {
            "0.1": {"state": "a", "overwrite": {"x": 1}, "scores": "{'FROC_score_IoU_0.10': 0.4, 'm': nan}"},
            "0.5": {"state": "a", "overwrite": {}, "scores": "{'FROC_score_IoU_0.10': 0.7}"},
            "0.9": {"state": "a", "overwrite": {}, "scores": "not a dict"},
        }
        (fold / "sweep" / "sweep_model_iou.json").write_text(json.dumps(sweep))
    lines = []
    for e in range(60):
        lines += [f"x | training_epoch_end:251 - Train loss reached: {1 - e / 20:.4f}", "noise",
                  f"x | validation_epoch_end:268 - Val loss reached: {2e-1 - e:.2e}"]
    (tmp_path / "fold0" / "train.log").write_text("\n".join(lines))
    return str(tmp_path)


def test_quality_report(spark, runs, tmp_path):
    report = P.quality_report(spark, runs, 2, str(tmp_path / "curves"))
    rows = {r["fold"]: r for r in report["metrics"].collect()}
    assert rows[1]["FROC_score_IoU_0.10"] == 0.6 and rows[None]["FROC_score_IoU_0.10"] == pytest.approx(0.55)
    name = "mAP_IoU_0.10_0.50_0.05_MaxDet_100"
    assert rows[1][name] != rows[1][name] and rows[None][name] == 0.2 and rows[None]["min_n_folds"] == 1
    assert rows[0]["AP_IoU_0.10_MaxDet_100"] != rows[0]["AP_IoU_0.10_MaxDet_100"]
    sweep = report["sweep"].where("fold = 0").first()
    assert (sweep["parameter"], sweep["best_label"], sweep["worst_label"]) == ("model_iou", "0.5", "0.1")
    status = {r["fold"]: r for r in report["convergence"].collect()}
    assert status[0]["status"] == "COMPLETE" and status[0]["monotone"]
    assert status[0]["final_loss"] == pytest.approx(-1.95) and status[0]["n_val_loss"] == 60
    assert (status[1]["status"], status[1]["error"]) == ("ERROR", "training log not found")
    assert not report["all_complete"].first()[0]
    curves = spark.read.option("header", True).csv(str(tmp_path / "curves"))
    assert curves.columns == ["epoch", "fold0_train_loss", "fold0_val_loss"] and curves.count() == 60


def test_malformed_scores_become_empty(spark, runs):
    sweep = {r["label"]: r["scores"] for r in R.read_sweep(spark, f"{runs}/fold0/sweep/*.json").collect()}
    assert sweep["0.9"] == {} and sweep["0.1"]["m"] != sweep["0.1"]["m"]


def test_short_logs_and_missing_losses(spark, tmp_path):
    rows = [(0, i, f"training_epoch_end - Train loss reached: {v}") for i, v in enumerate(["1.0", "n/a", "-2"])]
    lines = spark.createDataFrame(rows, "fold int, line_no long, line string")
    got = Q.convergence_summary(lines).first()
    assert (got["epochs_completed"], got["n_train_loss"], got["final_loss"]) == (3, 2, -2.0)
    assert got["error"].startswith("train loss extracted for only 2/3")
    assert Q.monotone_check(Q.loss_lines(lines)).first()["monotone"]
    arrays = Q.loss_arrays(Q.loss_lines(lines)).first()
    assert arrays["train_loss_per_epoch"] == [1.0, -2.0] and arrays["val_loss_per_epoch"] == []
    assert not R.write_loss_curves(Q.loss_lines(lines.limit(0)), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_run_cost(spark, tmp_path):
    runs = spark.createDataFrame([(0, "c", 1.0, 300.0, 0.5, "x"), (1, "c", 1.0, 100.0, 0.5, "x")],
                                 "fold int, checkpoint_path string, wall_clock_hours double, gpu_hours double, final_val_metric double, detector_commit string")
    row = Q.run_cost(runs).first()
    assert (row["total_gpu_hours"], row["extrapolated_gpu_hours"], row["exceeded"]) == (400.0, 1500.0, True)
    rate = runs.select(Q.epoch_rate_cost(F.lit(4.0), F.lit(60)).alias("c")).first()["c"]
    assert (rate["gpu_hours"], rate["exceeded"]) == (1200.0, False)
    M.write_run_summary(runs, str(tmp_path / "s"), "x")
    text = json.loads(spark.read.text(str(tmp_path / "s")).first()[0])
    assert text["total_gpu_hours"] == 400.0 and len(text["folds"]) == 2


def test_headers_of_any_length(spark, tmp_path):
    text = "NRRD0004\n" + "# note\n" * 20_000 + "dimension: 3\nsizes: 4 5 6\ntype: uchar\n"
    for k, end in enumerate(("\n", "\r\n")):
        body = text.replace("\n", end) + end
        (tmp_path / f"DATA_{k}.nrrd").write_bytes(body.encode() + b"\x00" * 100_000)
    headers = FS.read_headers(FS.discover_files(spark, str(tmp_path))).collect()
    assert [(r["dim"], list(r["sizes"]), r["dtype"]) for r in headers] == [(3, [4, 5, 6], "uint8")] * 2


def test_records_with_other_numbers_of_scores_are_rejected(spark):
    box = [0.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    rows = [("/x/1_boxes.json", [box, box], [0.5]), ("/x/2_boxes.json", [box], [0.5, 0.6]), ("/x/3_boxes.json", [box], [0.5])]
    records = spark.createDataFrame(rows, "path string, pred_boxes array<array<double>>, pred_scores array<double>")
    checked = S.checked_records(records)
    assert {r["case_id"] for r in checked.where("reason is null").collect()} == {3}
    assert S.explode_records(checked).count() == 1
