import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxlake.operators import audits as A
from voxlake.operators import candidates as C
from voxlake.operators import pooling as P
from voxlake.operators import voxels as VX
from voxlake.plans import datasets as D
from voxlake.workload import views as V

rng = np.random.default_rng(0)


def trilinear(grid, point):
    """One sample, straight from the definition."""
    at = [min(max(p, 0.0), n - 1.0) for p, n in zip(point, grid.shape, strict=True)]
    total = 0.0
    for i in range(grid.shape[0]):
        for j in range(grid.shape[1]):
            for k in range(grid.shape[2]):
                w = 1.0
                for p, n in zip(at, (i, j, k), strict=True):
                    w *= max(0.0, 1 - abs(p - n))
                total += w * grid[i, j, k]
    return total


def grid_frame(spark, grids):
    rows = [
        (t, *ix, [float(g[ix]) for g in channels])
        for t, channels in grids.items()
        for ix in np.ndindex(channels[0].shape)
    ]
    return spark.createDataFrame(rows, "tile_id long, d0 int, d1 int, d2 int, features array<float>")


def test_random_points_match_the_definition(spark):
    grids = {t: [rng.normal(size=(4, 5, 3)) for _ in range(2)] for t in range(2)}
    pts = [(i, i % 2, *map(float, rng.uniform(-1, 6, 3))) for i in range(60)]
    frame = spark.createDataFrame(pts, "pid long, tile_id long, p_d0 double, p_d1 double, p_d2 double")
    out = P.require_filled(P.pool_centroid(frame, grid_frame(spark, grids), (4, 5, 3), ["pid"], dim=2))
    got = {r["pid"]: r["embedding"] for r in out.collect()}
    for i, t, *p in pts:
        assert got[i] == pytest.approx([trilinear(g, p) for g in grids[t]], abs=1e-5)


def test_impulse_pins_the_axis_order(spark):
    g = np.zeros((4, 4, 4))
    g[1, 2, 3] = 1.0
    frame = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (1, 0, 3.0, 2.0, 1.0)],
                                  "pid long, tile_id long, p_d0 double, p_d1 double, p_d2 double")
    out = P.pool_centroid(frame, grid_frame(spark, {0: [g]}), (4, 4, 4), ["pid"])
    assert {r["pid"]: r["embedding"][0] for r in out.collect()} == {0: 1.0, 1: 0.0}


def test_region_mean_with_uneven_grid(spark):
    g = rng.normal(size=(5, 6, 7))
    boxes = [(i, 0, *map(float, lo), *map(float, lo + ext))
             for i, (lo, ext) in enumerate(zip(rng.uniform(-1, 5, (20, 3)), rng.uniform(0, 4, (20, 3)), strict=True))]
    names = "pid long, tile_id long, lo_d0 double, lo_d1 double, lo_d2 double, hi_d0 double, hi_d1 double, hi_d2 double"
    out = P.pool_roi(spark.createDataFrame(boxes, names), grid_frame(spark, {0: [g]}), (5, 6, 7), ["pid"], grid=(4, 2, 1))
    got = {r["pid"]: r["embedding"][0] for r in out.collect()}
    for i, _, *b in boxes:
        lo, hi = b[:3], b[3:]
        samples = [
            trilinear(g, [lo[a] + (k[a] + 0.5) * (hi[a] - lo[a]) / n for a, n in enumerate((1, 2, 4))])
            for k in np.ndindex(1, 2, 4)
        ]
        assert got[i] == pytest.approx(np.mean(samples), abs=1e-5)
    with pytest.raises(ValueError):
        P.pool_roi(None, None, (1, 1, 1), [], grid=(3, 3))


def test_missing_map_and_wrong_channels_fail(spark):
    point = spark.createDataFrame([(0, 5, 1.0, 1.0, 1.0)], "pid long, tile_id long, p_d0 double, p_d1 double, p_d2 double")
    maps = grid_frame(spark, {0: [np.zeros((2, 2, 2))]})
    with pytest.raises(PySparkException, match="PoolingError"):
        P.require_filled(P.pool_centroid(point, maps, (2, 2, 2), ["pid"])).collect()
    with pytest.raises(PySparkException, match="channels"):
        P.pool_centroid(point.withColumn("tile_id", F.lit(0)), maps, (2, 2, 2), ["pid"], dim=2).collect()


def test_nearest_tile_in_blocks_and_ties(spark):
    slots = spark.createDataFrame(
        [(1, i, [float(v) for v in (x, x, x + 4, x + 4, x, x + 4)]) for i, x in enumerate((0, 10, 30, 100))],
        "case_id long, det_idx long, slots array<double>")
    tiles = spark.createDataFrame([(1, t, o, o, o) for t, o in enumerate((0, 0, 20, 40))],
                                  "case_id long, tile_idx int, o_d0 long, o_d1 long, o_d2 long")
    for limit in (100, 2):
        rows = P.nearest_tile(slots, tiles, (8, 8, 8), block=limit).collect()
        assert {r["det_idx"]: r["tile_idx"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_no_box_is_lost_or_merged(spark):
    schema = "case_id long, fold int, det_idx long, slots array<double>"
    box = [0.0, 0.0, 4.0, 4.0, 0.0, 4.0]
    boxes = spark.createDataFrame([(1, 0, 1, box), (1, 0, 1, box), (2, 0, 1, box)], schema)
    tiles = spark.createDataFrame([(1, t, 8 * t, 0, 0) for t in range(5)],
                                  "case_id long, tile_idx int, o_d0 long, o_d1 long, o_d2 long")
    for block in (1, 100):
        rows = P.nearest_tile(boxes, tiles, (8, 8, 8), block=block).orderBy("case_id").collect()
        assert [(r["case_id"], r["tile_idx"]) for r in rows] == [(1, 0), (1, 0), (2, None)]
    voxels = spark.createDataFrame([(1, 0, 0, 0, 0, [1.0])],
                                   "case_id long, tile_idx int, d0 int, d1 int, d2 int, features array<double>")
    with pytest.raises(PySparkException, match="without tiles"):
        P.pool_at_boxes(boxes, tiles, voxels, (8, 8, 8), (1, 1, 1), 1).collect()


def test_missing_tile_properties_and_sizes_fail(spark):
    found = spark.createDataFrame([(1, 0, 0, [0.0] * 6, 0.5), (1, 9, 1, [0.0] * 6, 0.5)],
                                  "case_id long, tile_idx int, det_idx long, slots array<double>, score double")
    tiles = spark.createDataFrame([(1, 0, 0, 0, 0)], "case_id long, tile_idx int, o_d0 long, o_d1 long, o_d2 long")
    with pytest.raises(PySparkException, match="no tile"):
        C.tile_to_case(found, tiles).collect()
    props = spark.createDataFrame(
        [], "case_id long, transpose_backward array<int>, original_spacing array<double>,"
            " spacing_after_resampling array<double>, crop_low array<double>")
    with pytest.raises(PySparkException, match="no case properties"):
        C.restore_frame(found, props).collect()
    voxels = spark.createDataFrame([(1, 0, 0, 0, 5)], "case_id long, d0 int, d1 int, d2 int, intensity int")
    sizes = spark.createDataFrame([(2, 1, 1, 1)], "case_id long, n_d0 int, n_d1 int, n_d2 int")
    with pytest.raises(PySparkException, match="no size"):
        VX.resample_volume(voxels, sizes, (1, 1, 1), (1, 1, 1), "nearest").collect()


def test_unmatched_masks_keep_a_row(spark):
    voxels = spark.createDataFrame([(1, 0, 0, 0, 1), (2, 0, 0, 0, 0), (4, 1, 1, 1, 1)],
                                   "case_id long, d0 int, d1 int, d2 int, mask int")
    truth = spark.createDataFrame([(c, 0.5, 0.5, 0.5, 1.0, 1.0, 1.0) for c in (1, 2, 3)],
                                  "case_id long, c_x double, c_y double, c_z double, len_x double, len_y double, len_z double")
    checked = D.sanity_check(voxels, truth)
    status = {r["case_id"]: r["status"] for r in checked.collect()}
    assert {k: v for k, v in status.items() if k != 1} == {2: "empty mask", 3: "no mask", 4: "no truth"}
    assert status[1] in ("ok", "differs")
    with pytest.raises(PySparkException, match="mask|truth"):
        A.require_masks(checked).collect()
    best, summary = D.convention_audit(voxels, truth)
    rows = {(r["case_id"], r["status"]) for r in best.collect()}
    assert rows == {(1, "ok"), (2, "empty mask"), (3, "no mask"), (4, "no truth")}
    assert summary.first()["n_cases"] == 1


def test_mode_is_checked():
    with pytest.raises(ValueError):
        P.pool_at_boxes(None, None, None, (1, 1, 1), (1, 1, 1), 1, mode="max")


def volume_frame(spark, arrays, masks=None):
    rows = [
        (c, *ix, int(a[ix]), int((masks or arrays)[c][ix]) if masks else 0)
        for c, a in arrays.items()
        for ix in np.ndindex(a.shape)
    ]
    return spark.createDataFrame(rows, "case_id long, d0 int, d1 int, d2 int, intensity int, mask int")


def test_mask_and_volume_statistics(spark):
    arrays = {c: rng.integers(0, 256, (4, 5, 6)) for c in (1, 2)}
    masks = {1: np.zeros((4, 5, 6), int), 2: np.zeros((4, 5, 6), int)}
    masks[1][1:3, 2:4, 0:5] = 1
    frame = volume_frame(spark, arrays, masks)
    stats = {r["case_id"]: r for r in VX.mask_stats(frame).collect()}
    assert [stats[1][n] for n in ("min_d0", "min_d1", "min_d2", "max_d0", "max_d1", "max_d2")] == [1, 2, 0, 2, 3, 4]
    assert stats[1]["foreground"] == 20 and (stats[1]["c_d0"], stats[1]["c_d2"]) == (2, 2)
    assert stats[2]["foreground"] == 0 and stats[2]["min_d0"] is None
    assert [r["case_id"] for r in VX.empty_masks(VX.mask_stats(frame)).collect()] == [2]
    assert VX.tight_boxes(frame).count() == 1
    vol = {r["case_id"]: r for r in VX.volume_stats(frame).collect()}
    assert (vol[1]["n_d0"], vol[1]["n_d1"], vol[1]["n_d2"]) == (4, 5, 6)
    assert vol[1]["intensity_mean"] == pytest.approx(arrays[1].mean())
    percent = {r["axis"]: r for r in VX.slice_percentiles(frame, VX.mask_stats(frame)).collect()}
    assert percent[0]["p02"] == pytest.approx(np.percentile(arrays[1][2], 2))
    assert percent[2]["p98"] == pytest.approx(np.percentile(arrays[1][:, :, 2], 98))
    samples = {(r["case_id"], r["axis"]): r for r in VX.profile_samples(VX.axis_profile(frame)).collect()}
    profile = arrays[2].mean(axis=(0, 2))
    assert samples[(2, 1)]["p50"] == pytest.approx(profile[min(4, int(0.5 * 5))])
    binary = VX.binary_mask_check(VX.mask_stats(frame.withColumn("mask", F.expr("IF(d0 = 0, 2, mask)"))))
    assert not binary.where("binary").count()


@pytest.mark.parametrize("target", [(0.9, 0.4, 1.1), (0.2, 1.0, 0.3)])
def test_resampling_matches_the_gather_definition(spark, target):
    spacing, a = (0.3, 0.5, 0.4), rng.integers(0, 256, (6, 5, 7))
    sizes = spark.createDataFrame([(1, 6, 5, 7)], "case_id long, n_d0 long, n_d1 long, n_d2 long")
    frame = volume_frame(spark, {1: a})
    shape = [max(1, round(n * s / t)) for n, s, t in zip(a.shape, spacing, target, strict=True)]
    for mode in ("linear", "nearest"):
        rows = VX.resample_volume(frame, sizes, spacing, target, mode).collect()
        got = {(r["d0"], r["d1"], r["d2"]): r["intensity"] for r in rows}
        assert len(rows) == len(got) == int(np.prod(shape))
        for ix in np.ndindex(*shape):
            at = [i * (t / s) for i, s, t in zip(ix, spacing, target, strict=True)]
            if any(p > n - 0.5 for p, n in zip(at, a.shape, strict=True)):
                want = 0.0
            elif mode == "nearest":
                want = a[tuple(min(int(p + 0.5), n - 1) for p, n in zip(at, a.shape, strict=True))]
            else:
                want = trilinear(a, at)
            assert got[ix] == pytest.approx(want)
    with pytest.raises(ValueError):
        VX.resample_volume(frame, sizes, spacing, target, "cubic")


def test_nearest_resampling_does_not_shuffle(spark):
    sizes = spark.createDataFrame([(1, 6, 5, 7)], "case_id long, n_d0 long, n_d1 long, n_d2 long")
    frame = volume_frame(spark, {1: rng.integers(0, 2, (6, 5, 7))})
    plan = VX.resample_volume(frame, F.broadcast(sizes), (1, 1, 1), (2, 2, 2), "nearest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_sanity_and_convention(spark):
    mask = np.zeros((12, 14, 16), int)
    mask[2:5, 3:8, 4:11] = 1
    frame = volume_frame(spark, {1: mask}, {1: mask})
    truth = spark.createDataFrame([(1, 7.0, 5.0, 3.0, 6.0, 4.0, 2.0)],
                                  "case_id long, c_x double, c_y double, c_z double, len_x double, len_y double, len_z double")
    assert D.sanity_check(frame, truth).first()["ok"]
    best, summary = D.convention_audit(frame, truth)
    first = best.where("rank = 1").first()
    assert (first["perm"], first["exclusive"], first["residual"]) == ("210", False, 0.0)
    assert summary.first()["perm_consistent"] and best.count() == 3


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def generated(spark, value):
    """A row per voxel of 16 cubes, which Spark takes for 16 rows."""
    rows = spark.range(16).select(F.col("id").alias("case_id"))
    for a in ("d0", "d1", "d2"):
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.withColumns(value)


def test_generated_feature_maps_are_not_broadcast(spark):
    maps = generated(spark, {"features": F.array(F.col("d1").cast("double"))})
    points = spark.range(40).selectExpr(
        "id", "id % 16 AS case_id", "1D AS p_d0", "id % 3 + 0.25D AS p_d1", "2D AS p_d2"
    )
    pooled = P.pool_centroid(points, maps, (4, 4, 4), ("id",), ("case_id",))
    assert "BroadcastHashJoin" not in planned(pooled)
    got = {r["id"]: r["embedding"][0] for r in pooled.collect()}
    assert got == {i: i % 3 + 0.25 for i in range(40)}


def test_generated_voxels_stay_where_they_are_for_slices(spark):
    voxels = generated(
        spark,
        {"intensity": F.col("d0") * 4 + F.col("d1"), "mask": (F.col("case_id") < 15).cast("int") * (F.col("d0") % 2)},
    )
    rows = VX.slice_percentiles(voxels, VX.mask_stats(voxels))
    assert "BuildLeft" not in planned(rows)
    got = rows.collect()
    # the case without foreground has no slice
    assert {(r["case_id"], r["axis"]) for r in got} == {(c, a) for c in range(15) for a in range(3)}
    assert {r["n"] for r in got} == {16}
    slice_0 = [2 * 4 + d1 for d1 in range(4) for _ in range(4)]
    assert got[0]["p02"] is not None
    p98 = [r["p98"] for r in got if r["case_id"] == 0 and r["axis"] == 0]
    assert p98 == pytest.approx([np.percentile(slice_0, 98)])


def test_tasks_of_a_grid_grow_with_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "GRID_ROWS", 10_000)
    spark.range(60).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    cells = V.voxels(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() >= 60 * 3840 // 10_000
    assert cells.count() == 60 * 3840
