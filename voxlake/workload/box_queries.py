"""Registered queries over boxes and frames (P1-P34, F1-F8), each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import boxes as B
from voxlake.functions import frames, text
from voxlake.functions.vectors import l2_norm
from voxlake.operators import audits as A
from voxlake.operators import candidates as C
from voxlake.operators import folds as folds_
from voxlake.operators import quality as Q
from voxlake.operators import voxels as VX
from voxlake.schemas import NATIVE_SPACING_MM, TARGET_SPACING_MM
from voxlake.workload import views as V
from voxlake.workload.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

KEYS = ("case_id", "fold", "det_idx")
KEY_SQL = "case_id, fold, det_idx"
AX = ("d0", "d1", "d2")
S0, S1, S2 = NATIVE_SPACING_MM
T0, T1, T2 = TARGET_SPACING_MM


def r(column, digits: int = 6):
    return F.round(column, digits)


def iou_sql(a: str, b: str) -> str:
    """IoU of two inclusive boxes given by column prefixes."""
    inter = " * ".join(
        f"greatest(0, least({a}max_{x}, {b}max_{x}) - greatest({a}min_{x}, {b}min_{x}) + 1)" for x in AX
    )
    vol = {p: " * ".join(f"({p}max_{x} - {p}min_{x} + 1)" for x in AX) for p in (a, b)}
    return f"(({inter}) / CAST(({vol[a]}) + ({vol[b]}) - ({inter}) AS DOUBLE))"


TRUTH_BOX_SQL = """
SELECT case_id, CAST(c_z - len_z / 2 AS BIGINT) AS min_d0, CAST(c_y - len_y / 2 AS BIGINT) AS min_d1,
  CAST(c_x - len_x / 2 AS BIGINT) AS min_d2, CAST(c_z + len_z / 2 AS BIGINT) AS max_d0,
  CAST(c_y + len_y / 2 AS BIGINT) AS max_d1, CAST(c_x + len_x / 2 AS BIGINT) AS max_d2
FROM truth
"""


def truth_boxes(spark: SparkSession, d: str) -> DataFrame:
    center, size = frames.csv_columns()
    return V.truth(spark, d).select("case_id", frames.csv_to_box(center, size).alias("box"))


def boxed(spark: SparkSession, d: str, *columns) -> DataFrame:
    return V.proposals(spark, d).select(*KEYS, *columns)


@query(
    "p1_box_valid",
    f"""SELECT {KEY_SQL}, min_d0 <= max_d0 - 30 AND min_d1 <= max_d1 AND min_d2 <= max_d2 AS valid
        FROM proposals""",
)
def p1(spark, d):
    b = F.col("box")
    moved = B.make_box([B.lower(b, a) for a in AX], [B.upper(b, a) - n for a, n in zip(AX, (30, 0, 0), strict=True)])
    return boxed(spark, d, B.box_valid(moved).alias("valid"))


@query("p2_box_array", f"SELECT {KEY_SQL}, min_d0, min_d1, min_d2, max_d0, max_d1, max_d2 FROM proposals")
def p2(spark, d):
    back = B.array_to_box(B.box_to_array(F.col("box")))
    return boxed(spark, d, *B.flatten_box(back))


@query(
    "p3_box_volume",
    f"""SELECT {KEY_SQL}, CAST((max_d0 - min_d0 + 1) * (max_d1 - min_d1 + 1) * (max_d2 - min_d2 + 1)
        AS BIGINT) AS volume FROM proposals""",
)
def p3(spark, d):
    return boxed(spark, d, B.box_volume(F.col("box")).alias("volume"))


@query(
    "p4_box_extent",
    f"""SELECT {KEY_SQL}, max_d0 - min_d0 + 1 AS e0, max_d1 - min_d1 + 1 AS e1,
        max_d2 - min_d2 + 1 AS e2 FROM proposals""",
)
def p4(spark, d):
    e = B.box_extent(F.col("box"))
    return boxed(spark, d, *[e[i].alias(f"e{i}") for i in range(3)])


@query(
    "p5_box_center",
    f"""SELECT {KEY_SQL}, (min_d0 + max_d0) / 2.0 AS c0, (min_d1 + max_d1) / 2.0 AS c1,
        (min_d2 + max_d2) / 2.0 AS c2 FROM proposals""",
)
def p5(spark, d):
    c = B.box_center(F.col("box"))
    return boxed(spark, d, *[c[i].alias(f"c{i}") for i in range(3)])


@query(
    "p6_iou_3d",
    f"""SELECT case_id, fold, det_idx, round({iou_sql('a_', 'b_')}, 9) AS iou FROM (
        SELECT p.case_id, p.fold, p.det_idx, {', '.join(f'p.{s}_{x} AS a_{s}_{x}, t.{s}_{x} AS b_{s}_{x}' for s in ('min', 'max') for x in AX)}
        FROM proposals p JOIN truth_boxes t ON p.case_id = t.case_id) x""",
)
def p6(spark, d):
    pairs = V.proposals(spark, d).join(
        truth_boxes(spark, d).withColumnRenamed("box", "truth_box"), "case_id"
    )
    return pairs.select(*KEYS, r(B.iou_3d(F.col("box"), F.col("truth_box")), 9).alias("iou"))


@query(
    "p7_shape_stats",
    f"""SELECT {KEY_SQL}, round(e[1] * e[2] * e[3], 6) AS volume_mm3, round(e[3] / e[1], 9) AS elongation,
        round(e[3] / e[2], 9) AS anisotropy FROM (SELECT {KEY_SQL}, list_sort([(max_d0 - min_d0 + 1) * {S0}::DOUBLE,
        (max_d1 - min_d1 + 1) * {S1}::DOUBLE, (max_d2 - min_d2 + 1) * {S2}::DOUBLE]) AS e FROM proposals) x""",
)
def p7(spark, d):
    s = B.shape_stats(F.col("box"), NATIVE_SPACING_MM)
    return boxed(
        spark,
        d,
        r(s["volume_mm3"]).alias("volume_mm3"),
        r(s["elongation"], 9).alias("elongation"),
        r(s["anisotropy"], 9).alias("anisotropy"),
    )


@query(
    "p8_box_clip",
    f"""SELECT {KEY_SQL}, {', '.join(f'CASE WHEN ok THEN {n} ELSE -1 END AS {n}' for n in ('min_d0', 'min_d1', 'min_d2', 'max_d0', 'max_d1', 'max_d2'))}
        FROM (SELECT *, min_d0 <= max_d0 AND min_d1 <= max_d1 AND min_d2 <= max_d2 AS ok FROM (
          SELECT {KEY_SQL}, {', '.join(f'greatest(0, min_{x}) AS min_{x}, least(19, max_{x}) AS max_{x}' for x in AX)}
          FROM proposals) a) b""",
)
def p8(spark, d):
    clipped = B.box_clip(F.col("box"), (20, 20, 20), "null")
    rows = boxed(spark, d, clipped.alias("b")).select(*KEYS, *B.flatten_box(F.col("b")))
    return rows.fillna(-1)


@query(
    "p9_box_contains",
    f"""SELECT {KEY_SQL}, 25 BETWEEN min_d0 AND max_d0 AND 40 BETWEEN min_d1 AND max_d1
        AND 25 BETWEEN min_d2 AND max_d2 AS inside FROM proposals""",
)
def p9(spark, d):
    return boxed(spark, d, B.box_contains(F.col("box"), [F.lit(25), F.lit(40), F.lit(25)]).alias("inside"))


@query("p10_csv_to_box", "SELECT * FROM truth_boxes")
def p10(spark, d):
    return truth_boxes(spark, d).select("case_id", *B.flatten_box(F.col("box")))


def shifted_truth(spark, d):
    """Truth rows, a third of them moved off the integer grid on one axis."""
    return V.truth(spark, d).withColumn("c_y", F.expr("c_y + CASE WHEN case_id % 3 = 0 THEN 0.25D ELSE 0D END"))


@query(
    "p11_integer_endpoint_check",
    """SELECT case_id, CASE WHEN abs(c_y - len_y / 2 - round_even(c_y - len_y / 2, 0)) >= 1e-6 THEN 'min_y' END AS bad
       FROM (SELECT case_id, len_y, c_y + CASE WHEN case_id % 3 = 0 THEN 0.25 ELSE 0 END AS c_y FROM truth) x""",
)
def p11(spark, d):
    center, size = frames.csv_columns()
    return shifted_truth(spark, d).select("case_id", frames.integer_endpoint_check(center, size).alias("bad"))


@query(
    "p12_box_to_csv",
    f"""SELECT {KEY_SQL}, min_d2 + (max_d2 - min_d2) / 2.0 AS c_x, min_d1 + (max_d1 - min_d1) / 2.0 AS c_y,
        min_d0 + (max_d0 - min_d0) / 2.0 AS c_z, CAST(max_d2 - min_d2 AS DOUBLE) AS len_x,
        CAST(max_d1 - min_d1 AS DOUBLE) AS len_y, CAST(max_d0 - min_d0 AS DOUBLE) AS len_z FROM proposals""",
)
def p12(spark, d):
    return boxed(spark, d, frames.box_to_csv(F.col("box")).alias("r")).select(*KEYS, "r.*")


@query(
    "p13_box_to_yx_exclusive",
    f"""SELECT {KEY_SQL}, min_d0 AS y1, min_d1 AS x1, max_d0 + 1 AS y2, max_d1 + 1 AS x2, min_d2 AS z1,
        max_d2 + 1 AS z2 FROM proposals""",
)
def p13(spark, d):
    return boxed(spark, d, frames.box_to_yx_exclusive(F.col("box")).alias("r")).select(*KEYS, "r.*")


@query("p14_yx_exclusive_to_box", f"SELECT {KEY_SQL}, min_d0, min_d1, min_d2, max_d0, max_d1, max_d2 FROM proposals")
def p14(spark, d):
    there = boxed(spark, d, frames.box_to_yx_exclusive(F.col("box")).alias("r"))
    return there.select(*KEYS, *B.flatten_box(frames.yx_exclusive_to_box(F.col("r"))))


@query(
    "p15_voxel_to_mm",
    f"""SELECT {KEY_SQL}, round(1.5 + min_d0 * {S0}::DOUBLE, 9) AS m0, round(min_d1 * {S1}::DOUBLE, 9) AS m1,
        round(-2.0 + min_d2 * {S2}::DOUBLE, 9) AS m2 FROM proposals""",
)
def p15(spark, d):
    mm = frames.voxel_to_mm([B.lower(F.col("box"), a) for a in AX], NATIVE_SPACING_MM, (1.5, 0.0, -2.0))
    return boxed(spark, d, *[r(m, 9).alias(f"m{i}") for i, m in enumerate(mm)])


@query(
    "p16_mm_to_voxel",
    f"""SELECT {KEY_SQL}, round((min_d0 - 1.5) / {S0}::DOUBLE, 6) AS v0, round(min_d1 / {S1}::DOUBLE, 6) AS v1,
        round((min_d2 + 2.0) / {S2}::DOUBLE, 6) AS v2 FROM proposals""",
)
def p16(spark, d):
    v = frames.mm_to_voxel([B.lower(F.col("box"), a) for a in AX], NATIVE_SPACING_MM, (1.5, 0.0, -2.0))
    return boxed(spark, d, *[r(m).alias(f"v{i}") for i, m in enumerate(v)])


@query(
    "p17_box_center_mm",
    f"""SELECT {KEY_SQL}, round((min_d0 + max_d0) / 2.0 * {S0}::DOUBLE, 9) AS m0,
        round((min_d1 + max_d1) / 2.0 * {S1}::DOUBLE, 9) AS m1, round((min_d2 + max_d2) / 2.0 * {S2}::DOUBLE, 9) AS m2
        FROM proposals""",
)
def p17(spark, d):
    mm = frames.box_center_mm(F.col("box"), NATIVE_SPACING_MM)
    return boxed(spark, d, *[r(m, 9).alias(f"m{i}") for i, m in enumerate(mm)])


def _trip(edge: str, s: float, t: float) -> str:
    return f"greatest(0, round_even(round_even({edge} * ({s}::DOUBLE / {t}::DOUBLE), 0) / ({s}::DOUBLE / {t}::DOUBLE), 0))"


def roundtrip_sql(source: str) -> str:
    edges = []
    for x, s, t in zip(AX, NATIVE_SPACING_MM, TARGET_SPACING_MM, strict=True):
        low, high = _trip(f"min_{x}", s, t), _trip(f"(max_{x} + 1)", s, t)
        edges.append(f"CAST({low} AS BIGINT) AS r_min_{x}, CAST(greatest({high}, {low} + 1) - 1 AS BIGINT) AS r_max_{x}")
    return f"SELECT *, {', '.join(edges)} FROM {source}"


@query(
    "p18_box_grid_roundtrip",
    f"""SELECT {KEY_SQL}, {', '.join(f'r_{s}_{x} AS {s}_{x}' for s in ('min', 'max') for x in AX)}
        FROM ({roundtrip_sql('proposals')}) x""",
)
def p18(spark, d):
    back = frames.box_grid_roundtrip(F.col("box"), TARGET_SPACING_MM, NATIVE_SPACING_MM)
    return boxed(spark, d, back.alias("b")).select(*KEYS, *B.flatten_box(F.col("b")))


def residual_sql(source: str) -> str:
    mm = ", ".join(
        f"abs(r_{s}_{x} - {s}_{x}) * {sp}::DOUBLE" for s in ("min", "max") for x, sp in zip(AX, NATIVE_SPACING_MM, strict=True)
    )
    inside = " AND ".join(
        f"greatest(abs(r_min_{x} - min_{x}), abs(r_max_{x} - max_{x})) <= ceil((({t}::DOUBLE + {s}::DOUBLE) / 2.0) / {s}::DOUBLE)"
        for x, s, t in zip(AX, NATIVE_SPACING_MM, TARGET_SPACING_MM, strict=True)
    )
    return f"""SELECT *, greatest({mm}) AS worst, greatest({mm}) <= 0.5 AS primary_pass, {inside} AS structural_pass
        FROM ({roundtrip_sql(source)}) rt"""


@query(
    "p19_roundtrip_residuals",
    f"""SELECT {KEY_SQL}, round(worst, 9) AS max_residual_mm, primary_pass, structural_pass,
        primary_pass AND structural_pass AS gate_pass FROM ({residual_sql('proposals')}) x""",
)
def p19(spark, d):
    audited = A.roundtrip_audit(V.proposals(spark, d), TARGET_SPACING_MM, NATIVE_SPACING_MM)
    res = F.col("residuals")
    return audited.select(
        *KEYS,
        r(res["max_residual_mm"], 9).alias("max_residual_mm"),
        res["primary_pass"].alias("primary_pass"),
        res["structural_pass"].alias("structural_pass"),
        res["gate_pass"].alias("gate_pass"),
    )


@query(
    "p20_csv_endpoints",
    """SELECT case_id, c_x - len_x / 2 AS min_x, c_y - len_y / 2 AS min_y, c_z - len_z / 2 AS min_z,
       c_x + len_x / 2 AS max_x, c_y + len_y / 2 AS max_y, c_z + len_z / 2 AS max_z FROM truth""",
)
def p20(spark, d):
    minima, maxima = frames.csv_endpoints(*frames.csv_columns())
    named = [v.alias(f"min_{a}") for a, v in zip("xyz", minima, strict=True)]
    named += [v.alias(f"max_{a}") for a, v in zip("xyz", maxima, strict=True)]
    return V.truth(spark, d).select("case_id", *named)


def slots_box_sql(slot_map: dict, shift: dict | None = None) -> str:
    parts = []
    for x in AX:
        lo, hi = slot_map[x]
        plus = f" + {shift[x]}" if shift else ""
        low, high = f"CAST(round_even(s{lo}{plus}, 0) AS BIGINT)", f"CAST(round_even(s{hi}{plus}, 0) AS BIGINT)"
        parts.append(f"{low} AS min_{x}, greatest({high}, {low} + 1) AS max_{x}")
    return ", ".join(parts)


def degenerate_sql(slot_map: dict) -> str:
    return " OR ".join(f"round_even(s{slot_map[x][1]}, 0) < round_even(s{slot_map[x][0]}, 0)" for x in AX)


@query(
    "p21_detections_to_candidates",
    f"""SELECT case_id, det_idx, fold AS source, score, len(e.embedding) AS dim, {slots_box_sql(frames.RESTORED_SLOTS)}
        FROM slots JOIN embeddings e USING (vec_id) WHERE NOT ({degenerate_sql(frames.RESTORED_SLOTS)})""",
)
def p21(spark, d):
    vectors = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    detections = V.slot_detections(spark, d).join(vectors, "vec_id")
    kept, _ = C.detections_to_candidates(detections, "val", F.array("fold"), V.EMBEDDING_DIM)
    return kept.select(
        "case_id",
        "det_idx",
        F.col("source_detectors")[0].alias("source"),
        "score",
        F.size("embedding").cast("bigint").alias("dim"),
        *B.flatten_box(F.col("box")),
    )


def tiled(spark, d):
    """Slot detections spread over the eight tiles of their case."""
    return V.slot_detections(spark, d).withColumn("tile_idx", F.expr("CAST(det_idx % 8 AS INT)"))


@query(
    "p22_tile_to_case",
    f"""SELECT case_id, tile_idx, det_idx, {slots_box_sql(frames.TILE_SLOTS, {x: f'o_{x}' for x in AX})}
        FROM (SELECT *, CAST(det_idx % 8 AS INT) AS tile_idx FROM slots) s JOIN tiles USING (case_id, tile_idx)""",
)
def p22(spark, d):
    placed = C.tile_to_case(tiled(spark, d), V.tiles(spark, d))
    return placed.select("case_id", "tile_idx", "det_idx", *B.flatten_box(F.col("box")))


@query(
    "p23_pack_detection_columns",
    f"""SELECT {KEY_SQL}, CAST(min_d2 AS DOUBLE) AS x1, CAST(min_d1 AS DOUBLE) AS y1, CAST(max_d2 AS DOUBLE) AS x2,
        CAST(max_d1 AS DOUBLE) AS y2, CAST(min_d0 AS DOUBLE) AS z1, CAST(max_d0 AS DOUBLE) AS z2 FROM proposals""",
)
def p23(spark, d):
    packed = C.pack_detection_columns(V.proposals(spark, d))
    names = ("x1", "y1", "x2", "y2", "z1", "z2")
    return packed.select(*KEYS, *[F.col("slots")[i].alias(n) for i, n in enumerate(names)])


@query(
    "p24_to_feature_coords",
    f"""SELECT case_id, tile_idx, det_idx, {', '.join(f'round((s{a} - o_{x}) / 3.0, 6) AS lo_{x}, round((s{b} - o_{x}) / 3.0, 6) AS hi_{x}' for x, (a, b) in frames.RESTORED_SLOTS.items())}
        FROM (SELECT *, CAST(det_idx % 8 AS INT) AS tile_idx FROM slots) s JOIN tiles USING (case_id, tile_idx)""",
)
def p24(spark, d):
    joined = tiled(spark, d).join(V.tiles(spark, d), ["case_id", "tile_idx"])
    pairs = frames.to_feature_coords(F.col("slots"), F.array("o_d0", "o_d1", "o_d2"), V.CROP, V.FMAP)
    ends = [
        r(c).alias(f"{side}_{a}") for a, pair in zip(AX, pairs, strict=True) for side, c in zip(("lo", "hi"), pair, strict=True)
    ]
    return joined.select("case_id", "tile_idx", "det_idx", *ends)


@query(
    "p25_grid_norm",
    f"""SELECT {KEY_SQL}, round((s0 * 2 + 1) / 32.0 - 1, 9) AS pixel_norm, round(s0 * 2 / 31.0 - 1, 9) AS corner_norm
        FROM slots""",
)
def p25(spark, d):
    c = F.col("slots")[0]
    return V.slot_detections(spark, d).select(
        *KEYS,
        r(frames.grid_norm(c, 32), 9).alias("pixel_norm"),
        r(frames.grid_norm(c, 32, True), 9).alias("corner_norm"),
    )


PROPS_SQL = """
SELECT case_id, [1, 2, 0] AS tb, [0.073 + case_id % 3 * 0.1, 0.2, 0.475674] AS orig, [0.3, 0.3, 0.5] AS res,
  [CAST(case_id % 7 AS DOUBLE), 3.0, CAST(case_id % 2 AS DOUBLE)] AS crop FROM truth
"""


def case_props(spark, d):
    return V.truth(spark, d).selectExpr(
        "case_id",
        "array(1, 2, 0) AS transpose_backward",
        "array(0.073D + case_id % 3 * 0.1D, 0.2D, 0.475674D) AS original_spacing",
        "array(0.3D, 0.3D, 0.5D) AS spacing_after_resampling",
        "array(CAST(case_id % 7 AS DOUBLE), 3D, CAST(case_id % 2 AS DOUBLE)) AS crop_low",
    )


@query(
    "p26_restore_frame",
    f"""SELECT {KEY_SQL}, {', '.join(f'round({src} * res[{i}] / orig[{i}] + crop[{i}], 6) AS s{slot}' for slot, src, i in ((0, 's1', 1), (1, 's4', 2), (2, 's3', 1), (3, 's5', 2), (4, 's0', 3), (5, 's2', 3)))}
        FROM slots JOIN ({PROPS_SQL}) props USING (case_id)""",
)
def p26(spark, d):
    restored = C.restore_frame(V.slot_detections(spark, d), case_props(spark, d))
    return restored.select(*KEYS, *[r(F.col("slots")[i]).alias(f"s{i}") for i in range(6)])


@query(
    "p27_case_id_from_name",
    r"""SELECT path, try_cast(regexp_extract(path, '(?:DATA|MASK)_(\d+)\.nrrd$', 1) AS BIGINT) AS strict_id,
        try_cast(regexp_extract(path, '_(\d+)\.nrrd$', 1) AS BIGINT) AS lax_id FROM files""",
)
def p27(spark, d):
    return V.files(spark, d).select(
        "path",
        text.case_id_from_name(F.col("path")).alias("strict_id"),
        text.case_id_from_name(F.col("path"), strict=False).alias("lax_id"),
    )


@query(
    "p28_canonical_names",
    """SELECT case_id, concat(n, '_0000.nii.gz') AS image, concat(n, '.nii.gz') AS label, concat(n, '.json') AS sidecar
       FROM (SELECT case_id, CASE WHEN case_id < 1000 THEN lpad(CAST(case_id AS VARCHAR), 4, '0')
         ELSE CAST(case_id AS VARCHAR) END AS n FROM cases) x""",
)
def p28(spark, d):
    return V.cases(spark, d).select("case_id", text.canonical_names(F.col("case_id")).alias("n")).select("case_id", "n.*")


@query(
    "p29_resampled_size",
    f"""SELECT path, CAST(greatest(1, round_even(sizes[1] * {S0}::DOUBLE / {T0}::DOUBLE, 0)) AS BIGINT) AS n0,
        CAST(greatest(1, round_even(sizes[2] * {S1}::DOUBLE / {T1}::DOUBLE, 0)) AS BIGINT) AS n1,
        CAST(greatest(1, round_even(sizes[3] * {S2}::DOUBLE / {T2}::DOUBLE, 0)) AS BIGINT) AS n2
        FROM headers WHERE sizes IS NOT NULL""",
)
def p29(spark, d):
    out = [
        frames.resampled_size(F.col("sizes")[i], NATIVE_SPACING_MM[i], TARGET_SPACING_MM[i]).alias(f"n{i}") for i in range(3)
    ]
    return V.headers(spark, d).where("sizes IS NOT NULL").select("path", *out)


@query(
    "p30_physical_extent",
    f"""SELECT path, round(sizes[1] * {S0}::DOUBLE, 9) AS e0, round(sizes[2] * {S1}::DOUBLE, 9) AS e1,
        round(sizes[3] * {S2}::DOUBLE, 9) AS e2 FROM headers""",
)
def p30(spark, d):
    e = frames.physical_extent([F.col("sizes")[i] for i in range(3)], NATIVE_SPACING_MM)
    return V.headers(spark, d).select("path", *[r(v, 9).alias(f"e{i}") for i, v in enumerate(e)])


@query(
    "p31_parse_signed_float",
    r"""SELECT fold, line_no, try_cast(nullif(regexp_extract(line, 'Train loss reached:\s*(-?\d+\.?\d*(?:[eE][-+]?\d+)?)', 1), '')
        AS DOUBLE) AS loss FROM log_lines""",
)
def p31(spark, d):
    return V.log_lines(spark, d).select(
        "fold", "line_no", text.parse_signed_float(F.col("line"), text.TRAIN_LABEL).alias("loss")
    )


@query(
    "p32_last_metric_in_text",
    r"""SELECT doc_id, coalesce(try_cast(m[len(m)] AS DOUBLE), 0.0) AS metric FROM (SELECT doc_id,
        regexp_extract_all(text, '(?i)(?:best|val|metric)[^0-9\-]*([0-9]+\.[0-9]+)', 1) AS m FROM documents) x""",
)
def p32(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", text.last_metric_in_text(F.col("text")).alias("metric")
    )


@query(
    "p33_l2_norm",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)
       AS norm FROM embeddings""",
)
def p33(spark, d):
    return V.embeddings(spark, d).select("vec_id", r(l2_norm(F.col("embedding"))).alias("norm"))


@query("p34_retag", f"SELECT {KEY_SQL}, 'test' AS split, 3 AS source FROM proposals")
def p34(spark, d):
    tagged = C.retag(V.proposals(spark, d), "test", 3)
    return tagged.select(*KEYS, "split", F.col("source_detectors")[0].alias("source"))


# --- filters ----------------------------------------------------------------

_I = [[float(i == j) for j in range(3)] for i in range(3)]
_CLOSE = " AND ".join(
    f"abs(directions[{i + 1}][{j + 1}] - {_I[i][j]}) <= {1e-6 + 1e-5 * _I[i][j]!r}" for i in range(3) for j in range(3)
)
HEADER_REASON_SQL = f"""
CASE WHEN dim <> 3 THEN 'not 3-dimensional' WHEN directions IS NULL THEN 'no directions'
  WHEN len(directions) <> 3 THEN 'directions not 3x3' WHEN NOT ({_CLOSE}) THEN 'directions not identity'
  WHEN origin IS NULL THEN 'no origin'
  WHEN NOT (abs(origin[1]) <= 1e-6 AND abs(origin[2]) <= 1e-6 AND abs(origin[3]) <= 1e-6) THEN 'origin not zero'
  WHEN sizes IS NULL THEN 'no sizes' WHEN sizes <> shape THEN 'sizes differ from shape' END
"""


@query("f1_header_placeholder_check", f"SELECT path, {HEADER_REASON_SQL} AS reason FROM headers")
def f1(spark, d):
    return V.headers(spark, d).select("path", A.header_problem(F.col("shape")).alias("reason"))


@query(
    "f2_dtype_and_mask_check",
    """SELECT path AS item, CASE WHEN dtype <> 'uint8' THEN concat('dtype is ', dtype) END AS problem FROM headers
       UNION ALL SELECT CAST(case_id AS VARCHAR), CASE WHEN max(mask) > 1 OR min(mask) < 0 THEN 'mask not binary' END
       FROM voxels GROUP BY case_id""",
)
def f2(spark, d):
    types = V.headers(spark, d).select(F.col("path").alias("item"), A.dtype_problem().alias("problem"))
    masks = VX.binary_mask_check(VX.mask_stats(V.voxels(spark, d)))
    return types.unionByName(
        masks.select(
            F.col("case_id").cast("string").alias("item"),
            F.when(~F.col("binary"), "mask not binary").alias("problem"),
        )
    )


@query("f3_degenerate_boxes", f"SELECT {KEY_SQL} FROM slots WHERE {degenerate_sql(frames.RESTORED_SLOTS)}")
def f3(spark, d):
    bad = frames.slots_degenerate(F.col("slots"), frames.RESTORED_SLOTS)
    return V.slot_detections(spark, d).where(bad).select(*KEYS)


@query("f4_class_key_filter", "SELECT run_id, metric, val FROM metrics WHERE metric NOT LIKE '0\\_%' ESCAPE '\\'")
def f4(spark, d):
    return Q.without_class_keys(V.metrics(spark, d)).select("run_id", "metric", "val")


@query(
    "f5_number_filters",
    """SELECT metric, count(*) AS n, count(*) FILTER (WHERE val <> 'nan') AS n_number,
       count(*) FILTER (WHERE val <> 'nan' AND CAST(val AS DOUBLE) > 0) AS n_finite_inverse
       FROM metrics WHERE metric NOT LIKE '0\\_%' ESCAPE '\\' GROUP BY metric""",
)
def f5(spark, d):
    parsed = Q.parse_metrics(V.metrics(spark, d))
    inverse = F.when(F.col("value") > 0, 1 / F.col("value")).otherwise(F.lit(float("inf")))
    inverse = F.when(F.isnan("value"), F.col("value")).otherwise(inverse)
    return parsed.groupBy("metric").agg(
        F.count("*").alias("n"),
        F.count_if(Q.is_number(F.col("value"))).alias("n_number"),
        F.count_if(Q.is_finite(inverse)).alias("n_finite_inverse"),
    )


FOLDS_SQL = """
SELECT case_id, CAST((start + rn - 1) % 5 AS INT) AS fold, label FROM (
  SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(case_id AS VARCHAR))), case_id) AS rn
  FROM cases) c JOIN (
  SELECT label, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT label, min(case_id) AS f, count(*) AS n FROM cases GROUP BY label) g) s USING (label)
"""


def split_of(spark, d):
    return folds_.stratified_folds(V.cases(spark, d))


@query(
    "f6_train_and_oof_ids",
    """SELECT 'train' AS role, case_id FROM split WHERE fold <> 2 UNION ALL SELECT 'oof', case_id FROM split WHERE fold = 2""",
)
def f6(spark, d):
    split = split_of(spark, d)
    train = folds_.train_ids(split, 2).select(F.lit("train").alias("role"), "case_id")
    return train.unionByName(folds_.oof_ids(split, 2).select(F.lit("oof").alias("role"), "case_id"))


@query(
    "f7_spacing_tolerance",
    """SELECT path, axis, actual, expected FROM (SELECT path, unnest(['d0', 'd1', 'd2']) AS axis,
       unnest(spacing)::DOUBLE AS actual, unnest([0.3, 0.3, 0.5])::DOUBLE AS expected FROM headers) x
       WHERE abs(actual - expected) > 1e-6""",
)
def f7(spark, d):
    return A.spacing_audit(V.headers(spark, d), TARGET_SPACING_MM)


@query(
    "f8_required_keys",
    """SELECT event_id, array_to_string(list_filter(['k', 'v', 'w'], lambda x: NOT list_contains(json_keys(props), x)), ',')
       AS missing FROM events""",
)
def f8(spark, d):
    record = F.from_json("props", "map<string,string>")
    missing = A.missing_keys(record, ("k", "v", "w"))
    return V.table(spark, d, "events").select("event_id", F.array_join(missing, ",").alias("missing"))
