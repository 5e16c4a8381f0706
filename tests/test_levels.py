"""The level grid, and what clusters and joins hot cases over it."""

import random

import pytest
from pyspark.sql import functions as F

from test_clustering import brute_force, iou, proposals
from voxlake.functions import boxes as B
from voxlake.operators.clustering import cluster_members
from voxlake.operators.levels import CELL, cell_rows, level_of, level_range, levels_apart
from voxlake.operators.overlap import iou_join


def box(rng, edges, room):
    lows = [rng.randint(-room, room) for _ in range(3)]
    return (*lows, *(lo + rng.choice(edges) - 1 for lo in lows))


def mixed_rows(cases, n, seed, edges=(9, 10, 11, 4800, 5000), room=5200):
    """Boxes whose edges lie far apart, near copies of some among them."""
    rng = random.Random(seed)
    rows = []
    for c in range(cases):
        seen = []
        for i in range(n):
            if seen and rng.random() < 0.6:
                old = rng.choice(seen)
                moved = rng.choice(range(3))
                by = rng.choice([1, 2, 300])
                b = tuple(x + (by if k % 3 == moved else 0) for k, x in enumerate(old))
            else:
                b = box(rng, edges, room)
            seen.append(b)
            rows.append((c, i % 5, i, round(rng.random(), 3), b, [0.0]))
    return rows


def test_a_box_touches_eight_cells_of_its_level_at_most(spark):
    rng = random.Random(3)
    boxes = [box(rng, (1, 2, 3, 7, 8, 9, 1000, 1024, 1025, 1 << 20), 5000) for _ in range(200)]
    frame = spark.createDataFrame([(i, dict(zip(
        ("min_d0", "min_d1", "min_d2", "max_d0", "max_d1", "max_d2"), b))) for i, b in enumerate(boxes)],
        "i INT, box STRUCT<min_d0: BIGINT, min_d1: BIGINT, min_d2: BIGINT, max_d0: BIGINT, max_d1: BIGINT, max_d2: BIGINT>")
    for cell in (1, 7):
        own = frame.withColumn("own", level_of(F.col("box"), cell))
        for r in own.collect():
            b = boxes[r.i]
            longest = max(b[k + 3] - b[k] + 1 for k in range(3))
            assert cell << r.own >= longest and (r.own == 0 or cell << r.own - 1 < longest)
        counts = cell_rows(own, F.col("box"), level_range(F.col("own"), F.col("own") + 2), cell).groupBy("i", "_level").count()
        assert counts.agg(F.max("count")).first()[0] <= 8
        assert cell_rows(own, F.col("box"), level_range(F.col("own") + 1, F.col("own")), cell).count() == 0
    assert set(CELL) <= set(cell_rows(own, F.col("box"), level_range(F.col("own"), F.col("own"))).columns)


def test_levels_of_overlapping_boxes_are_near():
    assert [levels_apart(t) for t in (0.9, 0.5, 0.3, 0.25, 0.1)] == [1, 1, 2, 2, 4]
    assert levels_apart(0.0) is None


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.3, 0.5, 0.7])
def test_hot_cases_of_very_different_boxes(spark, threshold):
    rows = mixed_rows(2, 120, seed=4)
    got = {
        (m["case_id"], m["fold"], m["det_idx"]): (m["seed_fold"], m["seed_det_idx"])
        for m in cluster_members(proposals(spark, rows), threshold, max_group=5, pool=4).collect()
    }
    assert got == brute_force(rows, threshold)


def sides(spark, rows):
    frame = proposals(spark, rows)
    left = frame.where("fold < 2").select("case_id", F.col("det_idx").alias("l"), F.col("box").alias("left_box"))
    right = frame.where("fold >= 2").select("case_id", F.col("det_idx").alias("r"), F.col("box").alias("right_box"))
    return left, right


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.5])
def test_join_of_very_different_boxes(spark, threshold):
    rows = mixed_rows(2, 120, seed=8)
    want = sorted(
        (a[0], a[2], b[2]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < 2 <= b[1] and iou(a[4], b[4]) > threshold
    )
    got = iou_join(*sides(spark, rows), threshold, max_group=3).collect()
    assert sorted((j["case_id"], j["l"], j["r"]) for j in got) == want


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.5])
def test_a_cell_hot_on_both_sides_is_dealt_into_blocks(spark, threshold):
    rng = random.Random(6)
    rows = [
        (1, i % 5, i, 0.5, (*(lo := [rng.randint(16, 19) for _ in range(3)]), *(x + rng.randint(5, 7) for x in lo)), [0.0])
        for i in range(500)
    ]
    want = sorted(
        (a[0], a[2], b[2]) for a in rows for b in rows if a[1] < 2 <= b[1] and iou(a[4], b[4]) > threshold
    )
    left, right = sides(spark, rows)
    joined = iou_join(left, right, threshold, max_group=20)
    assert sorted((j["case_id"], j["l"], j["r"]) for j in joined.collect()) == want
    # no task takes the whole cell where the join is a shuffle
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    for key, value in zip(keys, ("false", "-1")):
        spark.conf.set(key, value)
    try:
        spread = iou_join(left, right, threshold, max_group=20).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert len(spread) > 1


def test_a_side_without_the_case(spark):
    left, right = sides(spark, mixed_rows(1, 30, seed=2))
    assert iou_join(left, right.where("case_id = 7"), 0.1, max_group=1).count() == 0
    assert iou_join(left.limit(0), right, 0.5, max_group=1).count() == 0


def test_without_hot_cases_only_the_sides_are_shuffled(spark):
    left, right = sides(spark, mixed_rows(2, 20, seed=8))
    plan = iou_join(left, right, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "_level" not in plan and "_h" not in plan


@pytest.mark.parametrize("max_group", [3, 4096])
def test_a_condition_comes_before_the_boxes_and_thresholds_stay_strict(spark, max_group):
    # boxes of one edge beside each other: many IoUs are exactly 1/3 or 1/2
    rows = spark.range(12).selectExpr("id", "explode(array(1L, 3L, 1000000L)) AS k")
    rows = rows.selectExpr(
        "1 AS case_id", "id * 10 + k % 7 AS n",
        "named_struct('min_d0', id, 'min_d1', 0L, 'min_d2', 0L, 'max_d0', id + 5, 'max_d1', k, 'max_d2', k) AS box")
    left = rows.selectExpr("case_id", "n AS a", "box AS left_box")
    right = rows.selectExpr("case_id", "n AS b", "box AS right_box")
    for t in (0.0, 1 / 3, 0.5):
        got = iou_join(left, right, t, max_group=max_group, only=F.col("a") < F.col("b"))
        plain = left.join(right, "case_id").where("a < b").withColumn("iou", B.iou_3d(F.col("left_box"), F.col("right_box")))
        want = sorted((r.a, r.b, r.iou) for r in plain.where(F.col("iou") > t).collect())
        assert want and sorted((r.a, r.b, r.iou) for r in got.collect()) == want
