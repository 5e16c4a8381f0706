"""Registered queries over joins, aggregates, windows, sorts and sets, with SQL checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxlake.functions import boxes as B
from voxlake.functions.vectors import l2_norm
from voxlake.operators import audits as A
from voxlake.operators import candidates as C
from voxlake.operators import folds as folds_
from voxlake.operators import pooling as P
from voxlake.operators import quality as Q
from voxlake.operators import voxels as VX
from voxlake.operators.clustering import cluster_boxes, order_candidates
from voxlake.operators.overlap import iou_join
from voxlake.schemas import METRICS, NATIVE_SPACING_MM, TARGET_SPACING_MM
from voxlake.session import ensure_checkpoint_dir
from voxlake.sources.manifests import file_digest, manifest_documents
from voxlake.sources.tables import keep_row
from voxlake.workload import views as V
from voxlake.workload.box_queries import (
    AX,
    HEADER_REASON_SQL,
    KEY_SQL,
    KEYS,
    iou_sql,
    r,
    residual_sql,
    split_of,
    truth_boxes,
)
from voxlake.workload.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

BOX_NAMES = [f"{s}_{x}" for s in ("min", "max") for x in AX]


def renamed(prefix: str, alias: str) -> str:
    return ", ".join(f"{alias}.{n} AS {prefix}{n}" for n in BOX_NAMES)


# --- joins ------------------------------------------------------------------


@query(
    "j1_attach_fold",
    """SELECT p.case_id, p.fold, p.det_idx, coalesce(s.fold, -1) AS fold_of FROM proposals p
       LEFT JOIN (SELECT * FROM split WHERE label = 'M') s ON p.case_id = s.case_id""",
)
def j1(spark, d):
    membership = split_of(spark, d).where("label = 'M'")
    joined = C.attach_fold(V.proposals(spark, d), membership)
    return joined.select(*KEYS, F.coalesce("fold_of", F.lit(-1)).alias("fold_of"))


@query(
    "j2_leakage_guard",
    "SELECT case_id FROM truth WHERE case_id IN (SELECT case_id FROM split WHERE fold <> 1)",
)
def j2(spark, d):
    return C.leaked_cases(V.truth(spark, d), split_of(spark, d), 1)


@query(
    "j3_scored_within_scope",
    """SELECT DISTINCT case_id FROM proposals
       WHERE case_id NOT IN (SELECT case_id FROM split WHERE fold = 1)""",
)
def j3(spark, d):
    return C.out_of_scope(V.proposals(spark, d), folds_.oof_ids(split_of(spark, d), 1))


@query(
    "j4_iou_join_truth",
    f"""SELECT * FROM (SELECT case_id, fold, det_idx, round({iou_sql('a_', 'b_')}, 9) AS iou FROM (
        SELECT p.case_id, p.fold, p.det_idx, {renamed('a_', 'p')}, {renamed('b_', 't')}
        FROM proposals p JOIN truth_boxes t ON p.case_id = t.case_id) x) y WHERE iou > 0.3""",
)
def j4(spark, d):
    left = V.spread(V.proposals(spark, d)).select(*KEYS, F.col("box").alias("left_box"))
    right = truth_boxes(spark, d).select("case_id", F.col("box").alias("right_box"))
    return iou_join(left, right, 0.3).select(*KEYS, r(F.col("iou"), 9).alias("iou"))


@query(
    "j4_iou_join_fold_pairs",
    f"""SELECT case_id, count(*) AS n_pairs, round(max(iou), 9) AS best, round(sum(iou), 6) AS total FROM (
        SELECT case_id, {iou_sql('a_', 'b_')} AS iou FROM (
          SELECT p.case_id, {renamed('a_', 'p')}, {renamed('b_', 'q')}
          FROM proposals p JOIN proposals q ON p.case_id = q.case_id AND p.fold < q.fold) x) y
        WHERE iou > 0.5 GROUP BY case_id""",
)
def j4_pairs(spark, d):
    """Agreement between folds, from all overlapping boxes of different folds."""
    both = V.proposals(spark, d)
    left = V.spread(both).select("case_id", F.col("fold").alias("a"), F.col("box").alias("left_box"))
    right = both.select("case_id", F.col("fold").alias("b"), F.col("box").alias("right_box"))
    # about half of the cases exceed this bound and take the grid-blocked plan
    joined = iou_join(left, right, 0.5, cell=32, max_group=100, only=F.col("a") < F.col("b"))
    return joined.groupBy("case_id").agg(
        F.count("*").alias("n_pairs"),
        r(F.max("iou"), 9).alias("best"),
        r(F.sum("iou")).alias("total"),
    )


NUMBERED_SQL = r"""
SELECT split, kind, path, try_cast(regexp_extract(path, '(?:DATA|MASK)_(\d+)\.nrrd$', 1) AS BIGINT) AS case_id FROM files
"""
PAIRS_SQL = f"""
SELECT split, case_id, min(path) FILTER (WHERE kind = 'DATA') AS data, min(path) FILTER (WHERE kind = 'MASK') AS mask
FROM ({NUMBERED_SQL}) n GROUP BY split, case_id
"""


def numbered(spark, d):
    return A.with_case_ids(V.files(spark, d))


@query(
    "j5_pair_volume_mask",
    f"""SELECT split, case_id, data, mask, CASE WHEN data IS NULL THEN 'extra mask' WHEN mask IS NULL
        THEN 'missing mask' ELSE 'paired' END AS status FROM ({PAIRS_SQL}) p""",
)
def j5(spark, d):
    return A.pair_volume_mask(numbered(spark, d))


SHAPES_SQL = f"""
SELECT path, [10, 20, case_id % 5 + CASE WHEN kind = 'MASK' AND case_id % 11 = 0 THEN 1 ELSE 0 END] AS sizes
FROM ({NUMBERED_SQL}) s
"""


def file_shapes(files):
    """(path, sizes) of catalog files, some masks one slice longer than their volume."""
    odd = (F.col("kind") == "MASK") & (F.col("case_id") % 11 == 0)
    third = F.col("case_id") % 5 + odd.cast("bigint")
    sizes = F.array(F.lit(10).cast("bigint"), F.lit(20).cast("bigint"), third).alias("sizes")
    return files.select("path", sizes).dropDuplicates(["path"])


@query(
    "j5_pair_shapes",
    f"""SELECT split, case_id, CASE WHEN data IS NULL THEN 'extra mask' WHEN mask IS NULL THEN 'missing mask'
        WHEN v.sizes <> m.sizes THEN 'shape differs' ELSE 'paired' END AS status
        FROM ({PAIRS_SQL}) p LEFT JOIN (SELECT path, any_value(sizes) AS sizes FROM ({SHAPES_SQL}) GROUP BY path) v ON v.path = data
        LEFT JOIN (SELECT path, any_value(sizes) AS sizes FROM ({SHAPES_SQL}) GROUP BY path) m ON m.path = mask""",
)
def j5_shapes(spark, d):
    files = numbered(spark, d)
    paired = A.pair_volume_mask(files, file_shapes(files))
    return paired.select("split", "case_id", "status")


@query(
    "j6_files_without_truth",
    f"""SELECT path, case_id FROM ({NUMBERED_SQL}) n WHERE kind = 'DATA'
        AND case_id NOT IN (SELECT case_id FROM truth)""",
)
def j6(spark, d):
    data = numbered(spark, d).where("kind = 'DATA'")
    return A.cases_without_truth(data, V.truth(spark, d)).select("path", "case_id")


@query(
    "j6_attach_truth_rows",
    """SELECT t.case_id, p.det_idx, t.len_x FROM truth t JOIN proposals p ON p.case_id = t.case_id""",
)
def j6_attach(spark, d):
    files = V.truth(spark, d).select("case_id", "len_x")
    rows = V.proposals(spark, d).select("case_id", "det_idx")
    return A.attach_truth_rows(files, rows).select("case_id", "det_idx", "len_x")


def _label_path(folder: str):
    return F.concat(F.lit(folder), F.format_string("%04d", F.col("case_id")), F.lit(".nii.gz"))


@query(
    "j7_missing_sidecars",
    """SELECT case_id, concat('labels/', CASE WHEN case_id < 1000 THEN lpad(CAST(case_id AS VARCHAR), 4, '0')
       ELSE CAST(case_id AS VARCHAR) END, '.nii.gz') AS path FROM cases WHERE label = 'B'""",
)
def j7(spark, d):
    cases = V.cases(spark, d)
    labels = cases.select("case_id", _label_path("labels/").alias("path"))
    sidecars = cases.where("label = 'M'").select(
        F.concat(F.lit("labels/"), F.format_string("%04d.json", F.col("case_id"))).alias("path")
    )
    return A.missing_sidecars(labels, sidecars).select("case_id", "path")


MOVED_SQL = "SELECT case_id, CASE WHEN case_id % 50 = 7 THEN (fold + 1) % 5 ELSE fold END AS fold, label FROM split"


def moved_split(spark, d):
    return split_of(spark, d).withColumn(
        "fold", F.expr("CASE WHEN case_id % 50 = 7 THEN (fold + 1) % 5 ELSE fold END")
    )


def roles_sql(split: str) -> str:
    return f"""SELECT f.k AS fold, CASE WHEN s.fold = f.k THEN 'val' ELSE 'train' END AS role, case_id
        FROM ({split}) s CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) f"""


@query(
    "j8_split_faithfulness",
    f"""(SELECT *, 'unexpected' AS problem FROM ({roles_sql(MOVED_SQL)} EXCEPT {roles_sql('SELECT * FROM split')}) a)
        UNION ALL
        (SELECT *, 'missing' AS problem FROM ({roles_sql('SELECT * FROM split')} EXCEPT {roles_sql(MOVED_SQL)}) b)""",
)
def j8(spark, d):
    produced = folds_.fold_roles(moved_split(spark, d))
    return folds_.split_faithfulness(produced, folds_.fold_roles(split_of(spark, d)))


@query(
    "j9_predictions_with_truth",
    """SELECT t.case_id, t.c_x, p.det_idx, p.score, p.rn AS rank FROM truth t LEFT JOIN (
       SELECT case_id, det_idx, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, det_idx DESC) AS rn
       FROM proposals) p ON t.case_id = p.case_id AND p.rn <= 3""",
)
def j9(spark, d):
    joined = Q.predictions_with_truth(V.proposals(spark, d), V.truth(spark, d), 3)
    return joined.select("case_id", "c_x", "det_idx", "score", F.col("rank").cast("bigint").alias("rank"))


@query("j10_attach_label", "SELECT case_id, label, c_z FROM truth JOIN cases USING (case_id)")
def j10(spark, d):
    return V.truth(spark, d).join(V.cases(spark, d), "case_id").select("case_id", "label", "c_z")


TIGHT_SQL = """
SELECT case_id, min(d0) AS min_d0, min(d1) AS min_d1, min(d2) AS min_d2, max(d0) AS max_d0, max(d1) AS max_d1,
  max(d2) AS max_d2, count(*) AS foreground FROM voxels WHERE mask > 0 GROUP BY case_id
"""
_PERMS = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if {a, b, c} == {0, 1, 2}]
_READINGS = ", ".join(
    f"({2 * i + o}, '{''.join(map(str, p))}', {p[0] + 1}, {p[1] + 1}, {p[2] + 1}, {o})"
    for i, p in enumerate(_PERMS)
    for o in (0, 1)
)
AXIS_SQL = f"""
SELECT case_id, 'ok' AS status, CAST(row_number() OVER (PARTITION BY case_id ORDER BY greatest(lo, hi), ordinal) AS BIGINT) AS rank,
  greatest(lo, hi) AS residual, ordinal, perm, o = 1 AS exclusive, lo AS min_residual, hi AS max_residual FROM (
  SELECT case_id, ordinal, perm, o,
    greatest(abs(lows[i] - min_d0), abs(lows[j] - min_d1), abs(lows[k] - min_d2)) AS lo,
    greatest(abs(highs[i] - (max_d0 + o)), abs(highs[j] - (max_d1 + o)), abs(highs[k] - (max_d2 + o))) AS hi
  FROM (SELECT t.case_id, [c_x - len_x / 2, c_y - len_y / 2, c_z - len_z / 2] AS lows,
      [c_x + len_x / 2, c_y + len_y / 2, c_z + len_z / 2] AS highs, b.* EXCLUDE (case_id)
    FROM truth t JOIN ({TIGHT_SQL}) b USING (case_id)) tb
  CROSS JOIN (VALUES {_READINGS}) v(ordinal, perm, i, j, k, o)) x
UNION ALL SELECT case_id, CASE WHEN t.case_id IS NULL THEN 'no truth' WHEN v.case_id IS NULL THEN 'no mask' ELSE 'empty mask' END, 1,
  NULL, -1, NULL, false, NULL, NULL
FROM truth t FULL JOIN (SELECT case_id, max(mask) AS mask FROM voxels GROUP BY 1) v USING (case_id)
WHERE t.case_id IS NULL OR v.case_id IS NULL OR v.mask = 0
"""


def searched(spark, d):
    rows = A.axis_permutation_search(V.truth(spark, d), VX.tight_boxes(V.voxels(spark, d), keep_empty=True))
    rows = rows.withColumn("rank", F.col("rank").cast("bigint"))
    # cases without a reading have no ordinal and no bound
    return rows.fillna({"ordinal": -1, "exclusive": False})


@query("j11_axis_permutation_search", AXIS_SQL)
def j11(spark, d):
    return searched(spark, d)


NEAREST_SQL = """
SELECT case_id, fold, det_idx, arg_min(tile_idx, (dist, tile_idx)) AS tile_idx, round(min(dist), 9) AS distance FROM (
  SELECT s.case_id, s.fold, s.det_idx, t.tile_idx, ((s0 + s2) / 2 - o_d0 - 12) ** 2 + ((s1 + s3) / 2 - o_d1 - 12) ** 2
    + ((s4 + s5) / 2 - o_d2 - 12) ** 2 AS dist
  FROM slots s JOIN tiles t ON s.case_id = t.case_id) x GROUP BY ALL
"""


@query("j12_nearest_tile", NEAREST_SQL.replace("GROUP BY ALL", "GROUP BY case_id, fold, det_idx"))
def j12(spark, d):
    boxes = V.spread(V.slot_detections(spark, d)).select(*KEYS, "slots")
    placed = P.nearest_tile(boxes, V.tiles(spark, d), V.CROP)
    return placed.select(*KEYS, "tile_idx", r(F.col("distance"), 9).alias("distance"))


@query("j12_nearest_tile_lattice", NEAREST_SQL.replace("GROUP BY ALL", "GROUP BY case_id, fold, det_idx"))
def j12_lattice(spark, d):
    # every case is searched through its lattice
    boxes = V.spread(V.slot_detections(spark, d)).select(*KEYS, "slots")
    placed = P.nearest_tile(boxes, V.tiles(spark, d), V.CROP, lattice_from=0)
    return placed.select(*KEYS, "tile_idx", r(F.col("distance"), 9).alias("distance"))


POINTS_SQL = """
SELECT l_suppkey AS tile_id,
  ((l_orderkey) * 8 + l_linenumber) * 10000000000 + l_partkey * 10000 + CAST(l_quantity AS BIGINT) AS point_id,
  l_quantity / 6 - 0.5 AS p_d0, l_discount * 70 + l_tax AS p_d1, CAST(l_partkey % 83 AS DOUBLE) / 11 AS p_d2 FROM lineitem
"""


def points(spark, d):
    return V.spread(V.table(spark, d, "lineitem")).selectExpr(
        "l_suppkey AS tile_id",
        """((l_orderkey) * 8 + l_linenumber) * 10000000000 + l_partkey * 10000
             + CAST(l_quantity AS BIGINT) AS point_id""",
        "l_quantity / 6 - 0.5D AS p_d0",
        "l_discount * 70 + l_tax AS p_d1",
        "CAST(l_partkey % 83 AS DOUBLE) / 11 AS p_d2",
    )


def corner_sql(source: str, ids: str, n: int, keep: str = "") -> str:
    """Eight clamped neighbours of p_d0, p_d1, p_d2 on an n-cube with trilinear weights."""
    idx = ", ".join(f"CAST(least(floor(q{a}) + k{a}, {n - 1}) AS INT) AS d{a}" for a in range(3))
    w = " * ".join(f"(CASE k{a} WHEN 1 THEN q{a} - floor(q{a}) ELSE floor(q{a}) + 1 - q{a} END)" for a in range(3))
    clamp = ", ".join(f"least(greatest(p_d{a}, 0.0), {n - 1}.0) AS q{a}" for a in range(3))
    return f"""SELECT {ids}, {keep}{idx}, {w} AS weight FROM (SELECT {ids}, {keep}{clamp} FROM ({source}) src) c
      CROSS JOIN (SELECT unnest([0, 1]) AS k0) a0 CROSS JOIN (SELECT unnest([0, 1]) AS k1) a1
      CROSS JOIN (SELECT unnest([0, 1]) AS k2) a2"""


@query(
    "j13_corner_gather",
    f"""SELECT tile_id, point_id, count(*) AS n_voxels, round(sum(weight), 6) AS total, round(min(value), 6) AS low,
        round(max(value), 6) AS high FROM (SELECT tile_id, point_id, d0, d1, d2, sum(weight) AS weight
          FROM ({corner_sql(POINTS_SQL, 'tile_id, point_id', 8)}) c GROUP BY ALL) g JOIN features USING (tile_id, d0, d1, d2)
        WHERE weight > 0 GROUP BY tile_id, point_id""".replace("GROUP BY ALL", "GROUP BY tile_id, point_id, d0, d1, d2"),
)
def j13(spark, d):
    coords = [(F.col(f"p_{a}"), F.col(f"p_{a}")) for a in AX]
    read = P.read_voxels(points(spark, d).distinct(), coords, V.FMAP, V.features(spark, d), ("tile_id", "point_id"), ("tile_id",))
    # a voxel that is missing has no value, and none of the view's is NULL
    joined = read.where("value IS NOT NULL")
    return joined.groupBy("tile_id", "point_id").agg(
        F.count("*").alias("n_voxels"),
        r(F.sum("weight")).alias("total"),
        r(F.min("value")).alias("low"),
        r(F.max("value")).alias("high"),
    )


@query(
    "j14_attach_by_ordinal",
    f"""SELECT {KEY_SQL}, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2))), 6) AS norm
        FROM proposals JOIN embeddings USING (vec_id)""",
)
def j14(spark, d):
    vectors = V.proposals(spark, d, embeddings=True).select(*KEYS, "embedding")
    boxes = V.slot_detections(spark, d).select(*KEYS, "slots")
    return C.attach_by_ordinal(boxes, vectors).select(*KEYS, r(l2_norm(F.col("embedding"))).alias("norm"))


@query(
    "j15_case_spacing",
    """SELECT t.case_id, coalesce(h.spacing[1], 0.073)::DOUBLE AS s0, coalesce(h.spacing[2], 0.2)::DOUBLE AS s1,
       coalesce(h.spacing[3], 0.475674)::DOUBLE AS s2 FROM truth t LEFT JOIN (
       SELECT CAST(p_size AS BIGINT) AS case_id, max([0.3, 0.3, 0.5]) AS spacing FROM part GROUP BY 1) h ON t.case_id = h.case_id""",
)
def j15(spark, d):
    known = V.table(spark, d, "part").groupBy(F.col("p_size").cast("bigint").alias("case_id")).agg(
        F.max(F.array(*[F.lit(v) for v in TARGET_SPACING_MM])).alias("spacing")
    )
    spaced = A.case_spacing(truth_boxes(spark, d), known)
    return spaced.select("case_id", *[F.col("spacing")[i].alias(f"s{i}") for i in range(3)])


MASK_TRUTH_SQL = f"""
SELECT case_id, round(iou, 9) AS iou, eq AS equal, eq AND iou >= 0.999 AS ok,
  CASE WHEN eq AND iou >= 0.999 THEN 'ok' ELSE 'differs' END AS status FROM (
  SELECT case_id, {iou_sql('a_', 'b_')} AS iou, {' AND '.join(f'a_{n} = b_{n}' for n in BOX_NAMES)} AS eq FROM (
    SELECT m.case_id, {renamed('a_', 'm')}, {renamed('b_', 't')} FROM ({TIGHT_SQL}) m
    JOIN truth_boxes t ON m.case_id = t.case_id) x) y
UNION ALL SELECT case_id, NULL, false, false,
  CASE WHEN t.case_id IS NULL THEN 'no truth' WHEN v.case_id IS NULL THEN 'no mask' ELSE 'empty mask' END
FROM truth_boxes t FULL JOIN (SELECT case_id, max(mask) AS mask FROM voxels GROUP BY 1) v USING (case_id)
WHERE t.case_id IS NULL OR v.case_id IS NULL OR v.mask = 0
"""


@query("j16_mask_vs_truth", MASK_TRUTH_SQL)
def j16(spark, d):
    checked = A.mask_vs_truth(VX.tight_boxes(V.voxels(spark, d), keep_empty=True), truth_boxes(spark, d))
    return checked.select("case_id", r(F.col("iou"), 9).alias("iou"), F.coalesce("equal", F.lit(False)).alias("equal"), "ok", "status")


# --- aggregations -----------------------------------------------------------


@query(
    "a1_fold_label_stats",
    """SELECT coalesce(fold, -1) AS fold, count(*) FILTER (WHERE label = 'B') AS benign,
       count(*) FILTER (WHERE label <> 'B') AS malignant,
       round(count(*) FILTER (WHERE label = 'B') / CAST(count(*) AS DOUBLE), 9) AS benign_fraction
       FROM split GROUP BY ROLLUP (fold)""",
)
def a1(spark, d):
    stats = folds_.fold_label_stats(split_of(spark, d))
    return stats.select(
        F.coalesce("fold", F.lit(-1)).alias("fold"),
        "benign",
        "malignant",
        r(F.col("benign_fraction"), 9).alias("benign_fraction"),
    )


@query(
    "a2_degenerate_folds",
    """SELECT fold, round(f, 9) AS benign_fraction, round(g, 9) AS overall_fraction, abs(f - g) > 0.02 AS degenerate FROM (
       SELECT nation AS fold, count(*) FILTER (WHERE label = 'B') / CAST(count(*) AS DOUBLE) AS f FROM (
         SELECT CAST(o_custkey % 25 AS INT) AS nation, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'M' ELSE 'B' END AS label
         FROM orders) o GROUP BY 1) x CROSS JOIN (SELECT count(*) FILTER (WHERE label = 'B') / CAST(count(*) AS DOUBLE) AS g FROM cases) y""",
)
def a2(spark, d):
    """An unstratified split, so that some folds do stray."""
    uneven = V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS case_id",
        "CAST(o_custkey % 25 AS INT) AS fold",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'M' ELSE 'B' END AS label",
    )
    rows = folds_.degenerate_folds(uneven, 0.02)
    return rows.select(
        "fold",
        r(F.col("benign_fraction"), 9).alias("benign_fraction"),
        r(F.col("overall_fraction"), 9).alias("overall_fraction"),
        "degenerate",
    )


def cluster_ctes(source: str, threshold: float = 0.5) -> str:
    """CTEs ``ranked`` and ``walk``: boxes in rank order, each with the rank of its owner."""
    fields = ", ".join(f"'{n}': r.{n}" for n in BOX_NAMES)
    hit = f"list_filter(w.seeds, lambda s: {iou_sql('s.', 'r.')} > {threshold})"
    return f"""WITH RECURSIVE ranked AS (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, fold, det_idx) AS rk FROM ({source}) src),
    walk AS (
      SELECT case_id, rk, [{{'rk': rk, {fields}}}] AS seeds, rk AS owner FROM ranked r WHERE rk = 1
      UNION ALL
      SELECT case_id, rk, CASE WHEN len(h) = 0 THEN list_append(seeds, me) ELSE seeds END,
        CASE WHEN len(h) = 0 THEN rk ELSE h[1].rk END
      FROM (SELECT r.case_id, r.rk, w.seeds, {{'rk': r.rk, {fields}}} AS me, {hit} AS h
        FROM walk w JOIN ranked r ON r.case_id = w.case_id AND r.rk = w.rk + 1) step)"""


@query(
    "a3_cluster_reduce",
    cluster_ctes("SELECT * FROM proposals JOIN embeddings USING (vec_id)")
    + """ SELECT case_id, seed_det_idx, n_members, round(e0, 5) + 0.0 AS e0, round(e31, 5) + 0.0 AS e31, round(e63, 5) + 0.0 AS e63,
         round(sqrt(e2), 4) AS norm FROM (
         SELECT case_id, owner, max(seed) AS seed_det_idx, sum(n)::BIGINT AS n_members, max(CASE WHEN i = 1 THEN m END) AS e0,
           max(CASE WHEN i = 32 THEN m END) AS e31, max(CASE WHEN i = 64 THEN m END) AS e63, sum(m * m) AS e2 FROM (
           SELECT case_id, owner, i, avg(x)::FLOAT::DOUBLE AS m, CASE WHEN i = 1 THEN count(*) ELSE 0 END AS n,
             max(CASE WHEN rk = owner THEN det_idx END) AS seed
           FROM (SELECT r.case_id, r.rk, w.owner, r.det_idx, unnest(range(1, 65)) AS i, unnest(r.embedding)::DOUBLE AS x
             FROM ranked r JOIN walk w ON r.case_id = w.case_id AND r.rk = w.rk) u GROUP BY case_id, owner, i) v
         GROUP BY case_id, owner) z""",
)
def a3(spark, d):
    clusters = cluster_boxes(
        V.proposals(spark, d),
        0.5,
        V.EMBEDDING_DIM,
        max_source=4,
        counted=V.proposals(spark, d).select("case_id"),
        vectors=V.embeddings(spark, d).select("vec_id", "embedding"),
    )
    e = F.col("embedding")
    return clusters.select(
        "case_id",
        "seed_det_idx",
        "n_members",
        *[r(e[i].cast("double"), 5).alias(f"e{i}") for i in (0, 31, 63)],
        r(l2_norm(e), 4).alias("norm"),
    )


SOURCED_SQL = """
SELECT case_id, fold, det_idx, CASE WHEN case_id % 3 = 0 THEN 'train' ELSE 'val' END AS split,
  CASE WHEN case_id % 3 = 0 THEN [fold] WHEN case_id % 7 = 0 THEN [] ELSE [fold, fold + 2] END AS src FROM proposals
"""


def sourced(spark, d):
    return V.proposals(spark, d).withColumn(
        "split", F.expr("CASE WHEN case_id % 3 = 0 THEN 'train' ELSE 'val' END")
    ).withColumn(
        "source_detectors",
        F.expr(
            """CASE WHEN case_id % 3 = 0 THEN array(fold)
                 WHEN case_id % 7 = 0 THEN CAST(array() AS array<int>) ELSE array(fold, fold + 2) END"""
        ),
    )


PROVENANCE_SQL = f"""
SELECT split, coalesce(rule, 'ok') AS rule, count(*) AS n FROM (SELECT c.split, CASE
    WHEN c.split = 'train' AND len(src) <> 1 THEN 'train: not exactly one source'
    WHEN c.split = 'train' AND s.fold IS NULL THEN 'train: case has no fold'
    WHEN c.split = 'train' AND src[1] <> s.fold THEN 'train: source is not the case''s fold'
    WHEN c.split <> 'train' AND len(src) = 0 THEN 'ensemble: no source'
    WHEN c.split <> 'train' AND list_max(src) >= 5 THEN 'ensemble: source id too high' END AS rule
  FROM ({SOURCED_SQL}) c LEFT JOIN split s ON c.case_id = s.case_id) x GROUP BY 1, 2
"""


@query("a4_provenance_report", PROVENANCE_SQL)
def a4(spark, d):
    rows = C.provenance_report(sourced(spark, d), split_of(spark, d))
    return rows.select("split", F.coalesce("rule", F.lit("ok")).alias("rule"), "n")


SUMMARY_SQL = f"""
SELECT split, n_vols, n AS n_candidates, round(n / CAST(n_vols AS DOUBLE), 6) AS mean_per_vol, round(score, 6) AS mean_score,
  CAST(dim AS INT) AS emb_dim, round(norm, 6) AS mean_l2, sources FROM (
  SELECT split, count(DISTINCT case_id) AS n_vols, count(*) AS n, avg(score) AS score, max(len(embedding)) AS dim,
    avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2)))) AS norm
  FROM (SELECT c.*, p.score, e.embedding FROM ({SOURCED_SQL}) c
    JOIN proposals p ON c.case_id = p.case_id AND c.fold = p.fold AND c.det_idx = p.det_idx
    JOIN embeddings e ON p.vec_id = e.vec_id) j GROUP BY split) a JOIN (
  SELECT split, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS sources FROM (SELECT DISTINCT split, unnest(src) AS x
    FROM ({SOURCED_SQL}) s) u GROUP BY split) b USING (split)
"""


@query("a5_candidate_summary", SUMMARY_SQL)
def a5(spark, d):
    vectors = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    summary = C.candidate_summary(sourced(spark, d).join(vectors, "vec_id"), V.EMBEDDING_DIM)
    return summary.select(
        "split",
        "n_vols",
        "n_candidates",
        r(F.col("mean_per_vol")).alias("mean_per_vol"),
        r(F.col("mean_score")).alias("mean_score"),
        "emb_dim",
        r(F.col("mean_l2")).alias("mean_l2"),
        F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"),
    )


def campaign_metrics(spark, d):
    return Q.parse_metrics(V.metrics(spark, d)).withColumns(
        {"campaign": F.expr("run_id DIV 5"), "fold": F.expr("CAST(run_id % 5 AS INT)")}
    )


@query(
    "a6_fold_metric_table",
    """SELECT campaign, fold, metric, CASE WHEN isnan(value) THEN -1 ELSE round(value, 9) END AS value, -1 AS min_n_folds FROM (
         SELECT run_id // 5 AS campaign, CAST(run_id % 5 AS INT) AS fold, metric, CAST(val AS DOUBLE) AS value FROM metrics
         WHERE NOT starts_with(metric, '0_')) f
       UNION ALL
       SELECT campaign, -1, metric, coalesce(round(value, 9), -1), least_n FROM (
         SELECT campaign, metric, value, min(nullif(n, 0)) OVER (PARTITION BY campaign) AS least_n FROM (
           SELECT run_id // 5 AS campaign, metric, avg(CASE WHEN val <> 'nan' THEN CAST(val AS DOUBLE) END) AS value,
             count(*) FILTER (WHERE val <> 'nan') AS n
           FROM metrics WHERE NOT starts_with(metric, '0_') GROUP BY 1, 2) a) b""",
)
def a6(spark, d):
    wide = Q.fold_metric_table(campaign_metrics(spark, d), ["campaign"])
    long = wide.unpivot(["campaign", "fold", "min_n_folds"], [f"`{m}`" for m in METRICS], "metric", "value")
    return long.select(
        "campaign",
        F.coalesce("fold", F.lit(-1)).alias("fold"),
        "metric",
        F.when(F.isnan("value"), F.lit(-1.0)).otherwise(r(F.col("value"), 9)).alias("value"),
        F.coalesce("min_n_folds", F.lit(-1)).alias("min_n_folds"),
    )


@query(
    "a7_sweep_extremes",
    """SELECT fold, parameter, arg_min(label, (-value, ordinal)) AS best_label, max(value) AS best_value,
       arg_max(label, (-value, ordinal)) AS worst_label, min(value) AS worst_value
       FROM sweep WHERE value IS NOT NULL GROUP BY fold, parameter""",
)
def a7(spark, d):
    return Q.sweep_extremes(V.sweep(spark, d))


LOSSES_SQL = r"""
SELECT fold, line_no, kind, try_cast(nullif(regexp_extract(line, CASE kind WHEN 'train' THEN 'Train' ELSE 'Val' END
    || ' loss reached:\s*(-?\d+\.?\d*(?:[eE][-+]?\d+)?)', 1), '') AS DOUBLE) AS loss FROM (
  SELECT *, CASE WHEN contains(line, 'training_epoch_end') THEN 'train' WHEN contains(line, 'validation_epoch_end') THEN 'val'
    END AS kind FROM log_lines) x WHERE kind IS NOT NULL
"""
CONVERGENCE_SQL = f"""
SELECT fold, count(*) FILTER (WHERE kind = 'train') AS epochs_completed,
  count(loss) FILTER (WHERE kind = 'train') AS n_train_loss, count(loss) FILTER (WHERE kind = 'val') AS n_val_loss,
  arg_min(loss, line_no) FILTER (WHERE kind = 'train') AS first_loss,
  arg_max(loss, line_no) FILTER (WHERE kind = 'train') AS final_loss,
  arg_max(loss, line_no) FILTER (WHERE kind = 'val') AS last_val_loss FROM ({LOSSES_SQL}) l GROUP BY fold
"""


@query(
    "a8_convergence_summary",
    f"""SELECT f.fold, coalesce(epochs_completed, 0) AS epochs_completed, coalesce(n_train_loss, 0) AS n_train_loss,
        coalesce(n_val_loss, 0) AS n_val_loss, first_loss, final_loss, last_val_loss,
        coalesce(epochs_completed, 0) = 60 AS training_complete,
        epochs_completed IS NOT NULL AND n_train_loss = epochs_completed AS loss_extraction_complete,
        CASE WHEN epochs_completed IS NULL THEN 'training log not found' END AS error
        FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS fold) f LEFT JOIN ({CONVERGENCE_SQL}) c ON f.fold = c.fold""",
)
def a8(spark, d):
    expected = spark.range(6).select(F.col("id").cast("int").alias("fold"))
    return Q.convergence_summary(V.log_lines(spark, d), expected)


@query(
    "a8_loss_arrays",
    f"""SELECT fold, count(*) FILTER (WHERE kind = 'train') AS n_train, count(*) FILTER (WHERE kind = 'val') AS n_val,
        sha256(coalesce(string_agg(printf('%.2f', loss), ',' ORDER BY line_no) FILTER (WHERE kind = 'train'), '')) AS train,
        sha256(coalesce(string_agg(printf('%.2f', loss), ',' ORDER BY line_no) FILTER (WHERE kind = 'val'), '')) AS val
        FROM ({LOSSES_SQL}) l WHERE loss IS NOT NULL GROUP BY fold""",
)
def a8_arrays(spark, d):
    arrays = Q.loss_arrays(Q.loss_lines(V.log_lines(spark, d)))

    def digest(column):
        return F.sha2(F.array_join(F.transform(column, lambda x: F.format_string("%.2f", x)), ","), 256)

    names = (("train", "train_loss_per_epoch"), ("val", "val_loss_per_epoch"))
    return arrays.select(
        "fold",
        *[F.size(c).cast("bigint").alias(f"n_{k}") for k, c in names],
        *[digest(c).alias(k) for k, c in names],
    )


GAP_SQL = """
SELECT i - 1 AS dim, round(o, 9) AS oof_var, round(e, 9) AS ens_var, round(o / e, 6) AS ratio FROM (
  SELECT i, var_pop(x) FILTER (WHERE split = 'train') AS o, var_pop(x) FILTER (WHERE split = 'val') AS e FROM (
    SELECT CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, unnest(range(1, 65)) AS i,
      unnest(embedding)::DOUBLE AS x FROM embeddings) u GROUP BY i) v
"""


def gap(spark, d):
    rows = V.embeddings(spark, d)
    return C.embedding_variance_gap(
        rows.where("split = 'train'"), rows.where("split = 'val'"), V.EMBEDDING_DIM
    )


@query("a9_embedding_variance_gap", GAP_SQL)
def a9(spark, d):
    return gap(spark, d).select(
        F.col("dim").cast("bigint").alias("dim"),
        r(F.col("oof_var"), 9).alias("oof_var"),
        r(F.col("ens_var"), 9).alias("ens_var"),
        r(F.col("ratio")).alias("ratio"),
    )


MAPPING_SQL = f"""
SELECT count(*) AS n_cases, string_agg(DISTINCT perm, ',' ORDER BY perm) AS perms, count(DISTINCT perm) = 1 AS perm_consistent,
  count(DISTINCT exclusive) = 1 AS exclusivity_consistent, max(residual) AS max_residual, round(avg(residual), 6) AS mean_residual
FROM ({AXIS_SQL}) s WHERE rank = 1 AND status = 'ok'
"""


@query("a10_axis_mapping_summary", MAPPING_SQL)
def a10(spark, d):
    row = A.axis_mapping_summary(searched(spark, d))
    return row.select(
        "n_cases",
        F.array_join("perms", ",").alias("perms"),
        "perm_consistent",
        "exclusivity_consistent",
        "max_residual",
        r(F.col("mean_residual")).alias("mean_residual"),
    )


@query(
    "a11_roundtrip_gate_summary",
    f"""SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_pass, count(*) FILTER (WHERE NOT ok) AS n_fail,
        round(max(worst), 9) AS worst_mm, bool_and(ok) AS all_pass FROM (
        SELECT worst, primary_pass AND structural_pass AS ok FROM ({residual_sql('proposals')}) x) y""",
)
def a11(spark, d):
    audited = A.roundtrip_audit(V.proposals(spark, d), TARGET_SPACING_MM, NATIVE_SPACING_MM)
    return A.roundtrip_gate_summary(audited).withColumn("worst_mm", r(F.col("worst_mm"), 9))


@query(
    "a12_mask_stats",
    """SELECT case_id, count(*) FILTER (WHERE mask > 0) AS foreground,
       CAST(min(d0) FILTER (WHERE mask > 0) AS BIGINT) AS min_d0, CAST(min(d1) FILTER (WHERE mask > 0) AS BIGINT) AS min_d1,
       CAST(min(d2) FILTER (WHERE mask > 0) AS BIGINT) AS min_d2, CAST(max(d0) FILTER (WHERE mask > 0) AS BIGINT) AS max_d0,
       CAST(max(d1) FILTER (WHERE mask > 0) AS BIGINT) AS max_d1, CAST(max(d2) FILTER (WHERE mask > 0) AS BIGINT) AS max_d2,
       CAST(round_even(avg(d0) FILTER (WHERE mask > 0), 0) AS BIGINT) AS c_d0,
       CAST(round_even(avg(d1) FILTER (WHERE mask > 0), 0) AS BIGINT) AS c_d1,
       CAST(round_even(avg(d2) FILTER (WHERE mask > 0), 0) AS BIGINT) AS c_d2,
       string_agg(DISTINCT CAST(mask AS VARCHAR), ',' ORDER BY CAST(mask AS VARCHAR)) AS mask_values
       FROM voxels GROUP BY case_id""",
)
def a12(spark, d):
    stats = VX.mask_stats(V.voxels(spark, d))
    return stats.withColumn("mask_values", F.array_join(F.col("mask_values").cast("array<string>"), ","))


@query(
    "a13_volume_stats",
    """SELECT case_id, CAST(max(d0) + 1 AS BIGINT) AS n_d0, CAST(max(d1) + 1 AS BIGINT) AS n_d1,
       CAST(max(d2) + 1 AS BIGINT) AS n_d2, min(intensity) AS intensity_min, max(intensity) AS intensity_max,
       round(avg(intensity), 9) AS intensity_mean FROM voxels GROUP BY case_id""",
)
def a13(spark, d):
    return VX.volume_stats(V.voxels(spark, d)).withColumn("intensity_mean", r(F.col("intensity_mean"), 9))


PROFILE_SQL = """
SELECT case_id, 0 AS axis, d0 AS index, avg(intensity) AS m FROM voxels GROUP BY case_id, d0 UNION ALL
SELECT case_id, 1, d1, avg(intensity) FROM voxels GROUP BY case_id, d1 UNION ALL
SELECT case_id, 2, d2, avg(intensity) FROM voxels GROUP BY case_id, d2
"""


@query("a14_axis_profile", f"SELECT case_id, axis, index, round(m, 9) AS mean_intensity FROM ({PROFILE_SQL}) p")
def a14(spark, d):
    return VX.axis_profile(V.voxels(spark, d)).withColumn("mean_intensity", r(F.col("mean_intensity"), 9))


_Q = (0.02, 0.15, 0.30, 0.50, 0.70, 0.85, 0.98)


@query(
    "a14_profile_samples",
    f"""SELECT case_id, axis, n, round(lo, 9) AS profile_min, round(hi, 9) AS profile_max,
        {', '.join(f'round(line[CAST(least(n - 1, floor({q}::DOUBLE * n)) AS BIGINT) + 1], 9) AS p{round(q * 100):02d}' for q in _Q)}
        FROM (SELECT case_id, axis, count(*) AS n, min(m) AS lo, max(m) AS hi, list(m ORDER BY index) AS line
          FROM ({PROFILE_SQL}) p GROUP BY case_id, axis) x""",
)
def a14_samples(spark, d):
    rows = VX.profile_samples(VX.axis_profile(V.voxels(spark, d)))
    rounded = [c for c in rows.columns if c not in ("case_id", "axis", "n")]
    return rows.select("case_id", "axis", "n", *[r(F.col(c), 9).alias(c) for c in rounded])


@query(
    "a15_slice_percentiles",
    """SELECT case_id, axis, count(*) AS n, round(quantile_cont(intensity, 0.02), 6) AS p02,
       round(quantile_cont(intensity, 0.98), 6) AS p98 FROM (
       SELECT v.case_id, unnest([0, 1, 2]) AS axis, unnest([d0 = c0, d1 = c1, d2 = c2]) AS hit, intensity FROM voxels v JOIN (
         SELECT case_id, round_even(avg(d0), 0) AS c0, round_even(avg(d1), 0) AS c1, round_even(avg(d2), 0) AS c2
         FROM voxels WHERE mask > 0 GROUP BY case_id) c ON v.case_id = c.case_id) x WHERE hit GROUP BY case_id, axis""",
)
def a15(spark, d):
    voxels = V.voxels(spark, d)
    rows = VX.slice_percentiles(voxels, VX.mask_stats(voxels))
    return rows.select("case_id", "axis", "n", r(F.col("p02")).alias("p02"), r(F.col("p98")).alias("p98"))


@query(
    "a16_split_digests",
    """SELECT fold, case_id // 500 AS block, count(*) AS n_cases,
       sha256(string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id)) AS sha256 FROM split GROUP BY 1, 2""",
)
def a16(spark, d):
    return folds_.split_digests(split_of(spark, d), 500)


@query(
    "a16_manifest_digest",
    """SELECT dataset, sha256('{"folds":[' || string_agg(ids, ',' ORDER BY fold) || '],"seed":42,"splitter_version":"v1"}') AS sha256
       FROM (SELECT case_id // 1000 AS dataset, fold, '[' || string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) || ']' AS ids
         FROM split GROUP BY 1, 2) f GROUP BY dataset""",
)
def a16_manifest(spark, d):
    """The digest that a manifest records of its folds, seed and version, one for each dataset."""
    datasets = split_of(spark, d).withColumn("dataset", F.expr("case_id DIV 1000"))
    documents = manifest_documents(datasets, "v1", keys=["dataset"])
    return documents.select("dataset", F.get_json_object("value", "$.sha256").alias("sha256"))


@query(
    "a17_file_digest",
    """SELECT CAST(doc_id % 64 AS INT) AS bucket,
       sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1""",
)
def a17(spark, d):
    """All texts written to 64 files in the order of their ids, and the files' raw bytes digested."""
    path = f"{ensure_checkpoint_dir(spark)}/voxlake-texts-{uuid.uuid4().hex}"
    rows = V.table(spark, d, "documents").selectExpr(
        "CAST(doc_id % 64 AS INT) AS bucket", "doc_id", "coalesce(text, '') AS value"
    )
    dealt = rows.repartition(64, "bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id")
    dealt.write.partitionBy("bucket").text(path)
    digests = file_digest(spark, f"{path}/*/*.txt")
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("int").alias("bucket")
    return digests.select(bucket, "sha256")


@query(
    "a17_text_digest",
    """SELECT 'documents' AS source, doc_id AS id, sha256(text) AS sha256 FROM documents
       UNION ALL SELECT 'pages', page_id, sha256(html) FROM pages""",
)
def a17_texts(spark, d):
    def digested(name, key, column):
        rows = V.table(spark, d, name)
        return rows.select(
            F.lit(name).alias("source"), F.col(key).alias("id"), F.sha2(column, 256).alias("sha256")
        )

    return digested("documents", "doc_id", "text").unionByName(digested("pages", "page_id", "html"))


@query(
    "a18_duplicate_case_files",
    f"""SELECT split, kind, case_id, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path
        FROM ({NUMBERED_SQL}) n GROUP BY split, kind, case_id HAVING count(*) > 1""",
)
def a18(spark, d):
    return A.duplicate_case_files(numbered(spark, d))


@query(
    "a18_surplus_files",
    f"""SELECT n.split, n.kind, n.case_id, n.path FROM ({NUMBERED_SQL}) n JOIN (
        SELECT split, kind, case_id, min(path) AS first FROM ({NUMBERED_SQL}) m GROUP BY split, kind, case_id) g
        ON n.split = g.split AND n.kind = g.kind AND n.case_id = g.case_id WHERE n.path > g.first""",
)
def a18_surplus(spark, d):
    return A.surplus_files(numbered(spark, d))


EXPECTED_SQL = """
SELECT CASE WHEN o_orderkey % 10 < 5 THEN 'Train' WHEN o_orderkey % 10 < 7 THEN 'Validation' ELSE 'Test' END AS split,
  count(*) FILTER (WHERE o_orderkey % 10 < 7 OR o_totalprice > 5000) AS n_expected FROM orders GROUP BY 1
UNION ALL SELECT 'Holdout', 5
"""


def expected_counts(spark, d):
    orders = V.table(spark, d, "orders")
    split = F.expr(
        "CASE WHEN o_orderkey % 10 < 5 THEN 'Train' WHEN o_orderkey % 10 < 7 THEN 'Validation' ELSE 'Test' END"
    )
    counts = orders.groupBy(split.alias("split")).agg(
        F.expr("count_if(o_orderkey % 10 < 7 OR o_totalprice > 5000)").alias("n_expected")
    )
    return counts.unionByName(spark.createDataFrame([("Holdout", 5)], "split string, n_expected long"))


@query(
    "a19_split_count_check",
    f"""SELECT e.split, n_expected, coalesce(n, 0) AS n_found, coalesce(n, 0) = n_expected AS ok FROM ({EXPECTED_SQL}) e
        LEFT JOIN (SELECT split, count(DISTINCT case_id) AS n FROM ({NUMBERED_SQL}) f WHERE kind = 'DATA' GROUP BY split) g
        ON e.split = g.split""",
)
def a19(spark, d):
    return A.split_count_check(numbered(spark, d), expected_counts(spark, d))


def order_lesions(spark, d):
    """Truth-like rows: one per line item of an order."""
    return V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"))


LESIONS_SQL = "SELECT l_orderkey AS case_id, count(*) AS n_lesions, count(*) > 1 AS rejected FROM lineitem GROUP BY l_orderkey"


@query("a20_lesion_counts", LESIONS_SQL)
def a20(spark, d):
    return A.lesion_counts(order_lesions(spark, d))


@query(
    "a21_header_audit_report",
    f"""SELECT coalesce(status, 'all') AS status, count(*) AS n_files FROM (
        SELECT CASE WHEN ({HEADER_REASON_SQL}) IS NULL THEN 'pass' ELSE 'fail' END AS status FROM headers) h
        GROUP BY ROLLUP (status)""",
)
def a21(spark, d):
    report = A.header_audit_report(V.headers(spark, d), F.col("shape"))
    return report.withColumn("status", F.coalesce("status", F.lit("all")))


@query(
    "a22_run_cost",
    """SELECT campaign, count(*) AS n_runs, round(sum(gpu_hours), 6) AS total_gpu_hours,
       round(max(gpu_hours) FILTER (WHERE fold = 0) * 5, 6) AS extrapolated_gpu_hours,
       coalesce(max(gpu_hours) FILTER (WHERE fold = 0) * 5 > 2400, false) AS exceeded FROM runs GROUP BY campaign""",
)
def a22(spark, d):
    cost = Q.run_cost(V.runs(spark, d), ["campaign"], trigger=2400.0)
    return cost.withColumns(
        {c: r(F.col(c)) for c in ("total_gpu_hours", "extrapolated_gpu_hours")}
    )


@query(
    "a22_epoch_rate_cost",
    """SELECT run_id, round(gpu_hours / 60 * 50 * 5, 6) AS gpu_hours, gpu_hours / 60 * 50 * 5 > 900 AS exceeded FROM runs""",
)
def a22_rate(spark, d):
    """What five folds of fifty epochs cost at each run's measured hours an epoch."""
    cost = Q.epoch_rate_cost(F.col("gpu_hours") / 60, F.lit(50), trigger=900.0)
    rows = V.runs(spark, d).select("run_id", cost.alias("c"))
    return rows.select("run_id", r(F.col("c.gpu_hours")).alias("gpu_hours"), "c.exceeded")


@query(
    "a23_embedding_audit",
    """SELECT case_id, n, box_ok, round(norm_min, 6) AS norm_min, round(norm_max, 6) AS norm_max, round(norm_mean, 6) AS norm_mean,
       round(var_min, 6) AS var_min, round(var_max, 6) AS var_max, round(var_mean, 6) AS var_mean, box_ok AS all_ok FROM (
       SELECT case_id, count(*) AS n, min(norm) AS norm_min, max(norm) AS norm_max, avg(norm) AS norm_mean,
         arg_min(s2 >= s0 AND s3 >= s1 AND s5 >= s4, det_idx) AS box_ok FROM (
         SELECT s.*, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2))) AS norm
         FROM slots s JOIN embeddings USING (vec_id)) a GROUP BY case_id) b JOIN (
       SELECT case_id, min(v) AS var_min, max(v) AS var_max, avg(v) AS var_mean FROM (
         SELECT case_id, i, var_pop(x) AS v FROM (SELECT case_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x
           FROM slots JOIN embeddings USING (vec_id)) u GROUP BY case_id, i) w GROUP BY case_id) c USING (case_id)""",
)
def a23(spark, d):
    vectors = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    audit = C.embedding_audit(V.slot_detections(spark, d).join(vectors, "vec_id"), V.EMBEDDING_DIM)
    stats = ("norm_min", "norm_max", "norm_mean", "var_min", "var_max", "var_mean")
    return audit.select("case_id", "n", "box_ok", *[r(F.col(c)).alias(c) for c in stats], "all_ok")


MONOTONE_SQL = f"""
SELECT fold, n, a AS first_mean, b AS last_mean, n < 10 OR b < a AS monotone FROM (
  SELECT fold, max(n) AS n, avg(loss) FILTER (WHERE up <= 5) AS a, avg(loss) FILTER (WHERE down <= 5) AS b FROM (
    SELECT fold, loss, count(*) OVER (PARTITION BY fold) AS n, row_number() OVER (PARTITION BY fold ORDER BY line_no) AS up,
      row_number() OVER (PARTITION BY fold ORDER BY line_no DESC) AS down
    FROM ({LOSSES_SQL}) l WHERE kind = 'train' AND loss IS NOT NULL) x GROUP BY fold) y
"""


@query(
    "a24_convergence_status",
    f"""SELECT fold, epochs_completed, monotone, CASE WHEN epochs_completed <> 60
        THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status
        FROM ({CONVERGENCE_SQL}) c JOIN ({MONOTONE_SQL}) m USING (fold)""",
)
def a24(spark, d):
    lines = V.log_lines(spark, d)
    status = Q.convergence_status(Q.convergence_summary(lines), Q.monotone_check(Q.loss_lines(lines)))
    return status.select("fold", "epochs_completed", "monotone", "status")


@query(
    "a25_dataset_build_summary",
    f"""SELECT count(*) FILTER (WHERE split = 'Train') AS n_train, count(*) FILTER (WHERE split = 'Validation') AS n_val,
        count(*) FILTER (WHERE split = 'Test') AS n_test, CAST(coalesce(sum(n_lesions), 0) AS BIGINT) AS total_lesions
        FROM ({PAIRS_SQL}) p LEFT JOIN ({LESIONS_SQL}) l USING (case_id) WHERE data IS NOT NULL AND mask IS NOT NULL""",
)
def a25(spark, d):
    pairs = A.pair_volume_mask(numbered(spark, d))
    return A.dataset_build_summary(pairs, A.lesion_counts(order_lesions(spark, d)))


# --- windows, sorts ---------------------------------------------------------


@query("w1_stratified_folds", "SELECT case_id, fold, label FROM split")
def w1(spark, d):
    return split_of(spark, d)


@query(
    "w1_stratified_folds_quality",
    """SELECT case_id, CAST((start + rn - 1) % 7 AS INT) AS fold, label FROM (
       SELECT doc_id AS case_id, quality * 2 + toxic AS label,
         row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) AS rn
       FROM labels) c JOIN (
       SELECT label, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM (SELECT quality * 2 + toxic AS label, min(doc_id) AS f, count(*) AS n FROM labels GROUP BY 1) g) s USING (label)""",
)
def w1_quality(spark, d):
    """Four classes and seven folds."""
    cases = V.table(spark, d, "labels").selectExpr("doc_id AS case_id", "quality * 2 + toxic AS label")
    return folds_.stratified_folds(cases, 7, 7)


RANK_SQL = "row_number() OVER (PARTITION BY case_id ORDER BY score DESC, fold, det_idx)"


@query("w2_score_rank", f"SELECT {KEY_SQL}, {RANK_SQL} AS rank FROM proposals")
def w2(spark, d):
    return C.score_rank(V.proposals(spark, d)).select(*KEYS, "rank")


@query(
    "w3_top_boxes",
    """SELECT case_id, fold, det_idx, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id
       ORDER BY CASE WHEN score < 0.2 THEN -1.0 ELSE score END DESC, det_idx DESC) AS rn FROM proposals) x WHERE rn <= 5""",
)
def w3(spark, d):
    """Low scores are turned into NaN, which must rank last."""
    with_nan = V.proposals(spark, d).withColumn(
        "score", F.when(F.col("score") < 0.2, F.lit(float("nan"))).otherwise(F.col("score"))
    )
    return C.top_boxes(with_nan, 5).select(*KEYS, "rank")


@query("w4_best_axis_matches", f"SELECT case_id, status, rank, perm, exclusive, residual FROM ({AXIS_SQL}) s WHERE rank <= 3")
def w4(spark, d):
    best = A.best_axis_matches(V.truth(spark, d), VX.tight_boxes(V.voxels(spark, d), keep_empty=True), 3)
    best = best.fillna({"exclusive": False})
    return best.select("case_id", "status", F.col("rank").cast("bigint").alias("rank"), "perm", "exclusive", "residual")


@query(
    "w5_monotone_check",
    f"SELECT fold, n, round(first_mean, 6) AS first_mean, round(last_mean, 6) AS last_mean, monotone FROM ({MONOTONE_SQL}) m",
)
def w5(spark, d):
    checked = Q.monotone_check(Q.loss_lines(V.log_lines(spark, d)))
    return checked.select(
        "fold", "n", r(F.col("first_mean")).alias("first_mean"), r(F.col("last_mean")).alias("last_mean"), "monotone"
    )


@query(
    "w6_epoch_ordinal",
    f"""SELECT fold, kind, line_no, loss, row_number() OVER (PARTITION BY fold, kind ORDER BY line_no) AS epoch
        FROM ({LOSSES_SQL}) l WHERE loss IS NOT NULL""",
)
def w6(spark, d):
    # a small bucket makes every fold span several
    numbered_ = Q.epoch_ordinal(Q.loss_lines(V.log_lines(spark, d)), lines_per_bucket=1000)
    return numbered_.select("fold", "kind", "line_no", "loss", F.col("epoch").cast("bigint").alias("epoch"))


@query(
    "w7_first_last_loss",
    f"""SELECT fold, kind, arg_min(loss, line_no) AS first_loss, arg_max(loss, line_no) AS last_loss
        FROM ({LOSSES_SQL}) l WHERE loss IS NOT NULL GROUP BY fold, kind""",
)
def w7(spark, d):
    return Q.first_last_loss(Q.loss_lines(V.log_lines(spark, d)))


@query(
    "w8_file_dedup",
    """SELECT 'last' AS keep, o_custkey AS case_id, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey
       UNION ALL SELECT 'first', o_custkey, arg_min(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""",
)
def w8(spark, d):
    rows = V.table(spark, d, "orders").selectExpr(
        "o_custkey AS case_id", "o_totalprice AS price", "o_orderkey AS row_no"
    )
    last, first = (
        keep_row(rows, ["case_id"], which).select(F.lit(which).alias("keep"), "case_id", "price")
        for which in ("last", "first")
    )
    return last.unionByName(first)


@query("o1_sorted_ids", "SELECT case_id FROM split WHERE fold = 0 ORDER BY case_id")
def o1(spark, d):
    return folds_.sorted_ids(folds_.oof_ids(split_of(spark, d), 0))


CLUSTER_SQL = (
    cluster_ctes("SELECT * FROM proposals")
    + f""" SELECT case_id, max(CASE WHEN rk = owner THEN det_idx END) AS seed_det_idx, count(*) AS n_members,
         round(avg(score), 9) AS score, {', '.join(f'max(CASE WHEN rk = owner THEN {n} END) AS {n}' for n in BOX_NAMES)},
         string_agg(DISTINCT CAST(fold AS VARCHAR), ',' ORDER BY CAST(fold AS VARCHAR)) AS sources
         FROM (SELECT r.*, w.owner FROM ranked r JOIN walk w ON r.case_id = w.case_id AND r.rk = w.rk) m GROUP BY case_id, owner"""
)


def flat_clusters(clusters):
    return clusters.select(
        "case_id",
        "seed_det_idx",
        "n_members",
        r(F.col("score"), 9).alias("score"),
        *B.flatten_box(F.col("box")),
        F.array_join(F.col("source_detectors").cast("array<string>"), ",").alias("sources"),
    )


@query("o2_order_candidates", CLUSTER_SQL)
def o2(spark, d):
    clusters = cluster_boxes(V.proposals(spark, d), 0.5, max_source=4)
    return flat_clusters(order_candidates(clusters))


@query("o3_first_cases", "SELECT case_id, c_x FROM truth ORDER BY case_id LIMIT 20")
def o3(spark, d):
    return A.first_cases(V.truth(spark, d), 20).select("case_id", "c_x")


@query("o4_order_files", "SELECT path FROM files ORDER BY path")
def o4(spark, d):
    return A.order_files(V.files(spark, d)).select("path")


@query(
    "o5_cap_detections",
    """SELECT case_id, fold, det_idx, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, fold
       ORDER BY score DESC, det_idx DESC) AS rn FROM proposals) x WHERE rn <= 10""",
)
def o5(spark, d):
    return C.cap_detections(V.proposals(spark, d), 10).select(*KEYS, "rank")


# --- sets -------------------------------------------------------------------


@query("u1_union_folds", f"SELECT {KEY_SQL}, score FROM proposals")
def u1(spark, d):
    rows = V.proposals(spark, d)
    by_fold = [rows.where(F.col("fold") == k) for k in range(5)]
    return C.union_folds(*by_fold).select(*KEYS, "score")


@query("u2_train_union", "SELECT case_id FROM split WHERE fold IN (0, 1, 2, 4)")
def u2(spark, d):
    return folds_.train_ids(split_of(spark, d), 3)


@query(
    "u3_set_diff_report",
    """SELECT case_id, 'left' AS side FROM (SELECT case_id FROM truth EXCEPT SELECT s_suppkey * 10 FROM supplier) a
       UNION ALL SELECT case_id, 'right' FROM (SELECT s_suppkey * 10 AS case_id FROM supplier EXCEPT SELECT case_id FROM truth) b""",
)
def u3(spark, d):
    other = V.table(spark, d, "supplier").select((F.col("s_suppkey") * 10).alias("case_id"))
    return folds_.set_diff(V.truth(spark, d), other, ["case_id"])


@query(
    "u4_missing_in",
    f"""SELECT DISTINCT case_id FROM ({NUMBERED_SQL}) a WHERE kind = 'DATA'
        AND case_id NOT IN (SELECT case_id FROM ({NUMBERED_SQL}) b WHERE kind = 'MASK')""",
)
def u4(spark, d):
    files = numbered(spark, d)
    return folds_.missing_in(files.where("kind = 'DATA'"), files.where("kind = 'MASK'"), ["case_id"])


@query(
    "u5_subset_check",
    """SELECT user_id, bool_and(event_type IN ('view', 'click', 'signup', 'error')) AS subset FROM events GROUP BY user_id""",
)
def u5(spark, d):
    allowed = ["view", "click", "signup", "error"]
    grouped = V.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("v"))
    return grouped.select("user_id", VX.subset_of(F.col("v"), allowed).alias("subset"))


@query(
    "u6_with_pooled",
    """SELECT fold, n, mean FROM (SELECT CAST(campaign AS BIGINT) AS fold, count(*) AS n, round(avg(gpu_hours), 6) AS mean FROM runs GROUP BY 1
       UNION ALL SELECT -1, count(*), round(avg(gpu_hours), 6) FROM runs) x""",
)
def u6(spark, d):
    rows = V.runs(spark, d)
    measures = [F.count("*").alias("n"), r(F.avg("gpu_hours")).alias("mean")]
    detail = rows.groupBy(F.col("campaign").cast("bigint").alias("fold")).agg(*measures)
    return Q.with_pooled(detail, rows.agg(*measures)).fillna(-1, ["fold"])


@query(
    "u7_case_scope",
    """SELECT DISTINCT 'train' AS split, case_id FROM split UNION ALL SELECT 'val', unnest(range(100, 130))
       UNION ALL SELECT 'test', unnest(range(130, 200))""",
)
def u7(spark, d):
    return folds_.case_scope(spark, split_of(spark, d))


@query(
    "u8_partition_check",
    """SELECT case_id, CAST(n AS BIGINT) AS n_folds, CASE WHEN NOT known THEN 'unknown case' WHEN n = 0 THEN 'in no fold'
       ELSE 'in several folds' END AS reason FROM (
       SELECT coalesce(c.case_id, s.case_id) AS case_id, coalesce(s.n, 0) AS n, c.case_id IS NOT NULL AS known
       FROM (SELECT DISTINCT o_custkey AS case_id FROM orders) c FULL JOIN
         (SELECT l_suppkey * 3 AS case_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) s ON c.case_id = s.case_id) x
       WHERE NOT known OR n <> 1""",
)
def u8(spark, d):
    """Line items as a badly broken split of customers."""
    broken = V.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") * 3).alias("case_id"), F.col("l_linenumber").alias("fold")
    ).distinct()
    cases = V.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"))
    return folds_.partition_check(broken, cases)
