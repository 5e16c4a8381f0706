"""Table schemas and default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

# Geometry defaults, expected counts and gates of the data set.
NATIVE_SPACING_MM = (0.073, 0.200, 0.475674)
TARGET_SPACING_MM = (0.3, 0.3, 0.5)
ORIGIN_MM = (0.0, 0.0, 0.0)
ROUNDTRIP_GATE_MM = 0.5
TRUTH_IOU_GATE = 0.999
HEADER_ATOL = 1e-6
HEADER_RTOL = 1e-5
SPACING_ATOL = 1e-6
ENDPOINT_ATOL = 1e-6
EMBEDDING_DIM = 128
EXPECTED_CASES = {"train": 100, "val": 30, "test": 70}
N_FOLDS = 5
SPLIT_SEED = 42
EXPECTED_EPOCHS = 60
LABELS = ("B", "M")
PROFILE_POSITIONS = (0.02, 0.15, 0.30, 0.50, 0.70, 0.85, 0.98)
SLICE_PERCENTILES = (0.02, 0.98)
FROC_METRICS = tuple(f"FROC_score_IoU_0.{i}0" for i in range(1, 10))
AP_METRICS = tuple(f"AP_IoU_0.{i}0_MaxDet_100" for i in range(1, 6))
MAP_METRIC = "mAP_IoU_0.10_0.50_0.05_MaxDet_100"
METRICS = FROC_METRICS + AP_METRICS + (MAP_METRIC,)
DATASET_KEYS = ("task", "dim", "modalities", "labels", "test_labels")
GPU_HOUR_TRIGGER = 1300.0

AXES = ("d0", "d1", "d2")
BOX_FIELDS = ("min_d0", "min_d1", "min_d2", "max_d0", "max_d1", "max_d2")

BOX = T.StructType([T.StructField(name, T.LongType()) for name in BOX_FIELDS])

CANDIDATE = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("box", BOX),
        T.StructField("score", T.DoubleType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("source_detectors", T.ArrayType(T.IntegerType())),
        T.StructField("detector_commit", T.StringType()),
    ]
)

TRUTH_ROW = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("c_x", "c_y", "c_z", "len_x", "len_y", "len_z")]
)

MANIFEST = T.StructType(
    [
        T.StructField("splitter_version", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("n_folds", T.IntegerType()),
        T.StructField("labels_csv_sha256", T.StringType()),
        T.StructField("folds", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("label_of", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sha256", T.StringType()),
    ]
)

DETECTION_RECORD = T.StructType(
    [
        T.StructField("pred_boxes", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("pred_scores", T.ArrayType(T.FloatType())),
    ]
)

SWEEP_ENTRY = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("overwrite", T.MapType(T.StringType(), T.StringType())),
        T.StructField("scores", T.StringType()),
    ]
)

HEADER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("directions", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("origin", T.ArrayType(T.DoubleType())),
        T.StructField("dtype", T.StringType()),
        T.StructField("problem", T.StringType()),
    ]
)
