import json

from pyspark.sql import functions as F

from voxlake.__main__ import main
from voxlake.operators import audits as A
from voxlake.schemas import BOX
from voxlake.sources import manifests as M
from voxlake.sources import tables as T


def test_split_and_candidate_commands(spark, tmp_path, capsys):
    labels, manifest = tmp_path / "labels.csv", str(tmp_path / "manifest")
    labels.write_text("case_id,label\n" + "".join(f"{i},{'BM'[i % 2]}\n" for i in range(20)))
    assert main(["make-split", str(labels), manifest, "--expected", "20"]) == 0
    assert main(["verify-split", str(labels), manifest, "--expected", "20"]) == 0
    assert main(["verify-split", str(labels), manifest]) == 1
    split = M.read_split_manifest(spark, manifest)
    box = F.struct(*[F.lit(1).cast("bigint").alias(n) for n in BOX.fieldNames()])
    rows = split.select(
        "case_id",
        F.when(F.col("case_id") < 10, "train").otherwise("val").alias("split"),
        box.alias("box"),
        F.lit(0.5).alias("score"),
        F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"),
        F.array("fold").alias("source_detectors"),
    )
    T.write_candidates(rows, str(tmp_path / "good"))
    gap = str(tmp_path / "gap")
    command = ["candidates", str(tmp_path / "good"), manifest, "--dim", "2", "--gap-report", gap]
    assert main(command) == 0
    assert set(json.loads(spark.read.text(gap).first()[0])) == {
        "pooled_mean_ratio", "per_dim_oof_var_mean", "per_dim_ensemble_var_mean"}
    leaked = rows.withColumn("source_detectors", F.array((F.col("source_detectors")[0] + 1) % 5))
    T.write_candidates(leaked, str(tmp_path / "bad"))
    assert main(["candidates", str(tmp_path / "bad"), manifest, "--dim", "2"]) == 1
    assert "ProvenanceError" in capsys.readouterr().err


def test_header_and_quality_commands(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    root.mkdir()
    text = "NRRD0004\ntype: uchar\ndimension: 3\nsizes: 1 1 1\nspace directions: {}\nspace origin: (0,0,0)\n\n"
    (root / "DATA_1.nrrd").write_text(text.format("(1,0,0) (0,1,0) (0,0,1)"))
    assert main(["headers", str(root)]) == 0
    (root / "MASK_1.nrrd").write_text(text.format("(2,0,0) (0,1,0) (0,0,1)"))
    assert main(["headers", str(root)]) == 1
    fold = tmp_path / "runs" / "fold0"
    (fold / "val_results").mkdir(parents=True)
    (fold / "sweep").mkdir()
    (fold / "val_results" / "results_boxes.json").write_text('{"FROC_score_IoU_0.10": "0.5"}')
    (fold / "sweep" / "sweep_model_iou.json").write_text("{}")
    (fold / "train.log").write_text("training_epoch_end - Train loss reached: 0.5\n")
    assert main(["quality", str(tmp_path / "runs"), "--folds", "1"]) == 0
    assert "INCOMPLETE" in capsys.readouterr().out


def test_shape_mismatches(spark):
    a = spark.createDataFrame([(1, [4, 5, 6]), (2, [4, 5, 6])], "case_id long, sizes array<long>")
    b = spark.createDataFrame([(1, [4, 5, 6]), (2, [4, 5, 7])], "case_id long, sizes array<long>")
    assert [r["case_id"] for r in A.shape_mismatches(a, b).collect()] == [2]
