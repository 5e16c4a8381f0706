import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import clustering, skew
from voxlake.operators.clustering import cluster_boxes, cluster_members, order_candidates
from voxlake.operators.overlap import iou_join
from voxlake.schemas import BOX

SCHEMA = (
    f"case_id long, fold int, det_idx long, score double, box {BOX.simpleString()}, "
    "source_detectors array<int>, embedding array<float>"
)


def proposals(spark, rows):
    data = [(c, f, i, s, b, [f], e) for c, f, i, s, b, e in rows]
    return spark.createDataFrame(data, SCHEMA)


def iou(a, b):
    inter = 1
    for k in range(3):
        inter *= max(0, min(a[k + 3], b[k + 3]) - max(a[k], b[k]) + 1)
    vol = [(x[3] - x[0] + 1) * (x[4] - x[1] + 1) * (x[5] - x[2] + 1) for x in (a, b)]
    return inter / (vol[0] + vol[1] - inter)


def brute_force(rows, threshold):
    """Owner (fold, det_idx) of every proposal, one case at a time."""
    owners = {}
    for case in {r[0] for r in rows}:
        todo = sorted((r for r in rows if r[0] == case), key=lambda r: (-r[3], r[1], r[2]))
        while todo:
            seed = todo[0]
            taken = [r for r in todo if r is seed or iou(seed[4], r[4]) > threshold]
            owners.update({(case, r[1], r[2]): (seed[1], seed[2]) for r in taken})
            todo = [r for r in todo if r not in taken]
    return owners


def random_rows(n_cases, n, seed, spread=40, copies=0):
    rng = random.Random(seed)
    rows = []
    for case in range(n_cases):
        for i in range(n):
            lo = [rng.randrange(spread) for _ in range(3)]
            b = (*lo, *(v + rng.randrange(8, 16) for v in lo))
            rows.append((case, i % 5, i, rng.randrange(10) / 10, b, [1.0, float(i)]))
        for i in range(copies):
            rows.append((case, 0, n + i, 0.95, (1, 1, 1, 12, 12, 12), [0.0, 0.0]))
    return rows


def test_three_folds_agree(spark):
    b = (0, 0, 0, 5, 5, 5)
    rows = [(1, f, 0, s, b, [float(f), 3.0]) for f, s in ((0, 0.9), (1, 0.6), (2, 0.3))]
    got = cluster_boxes(proposals(spark, rows), dim=2).collect()
    assert len(got) == 1
    assert got[0]["score"] == pytest.approx(0.6)
    assert got[0]["embedding"] == pytest.approx([1.0, 3.0])
    assert got[0]["source_detectors"] == [0, 1, 2]
    assert tuple(got[0]["box"]) == b and got[0]["n_members"] == 3


def test_disjoint_boxes_stay_apart_and_empty_stays_empty(spark):
    rows = [(1, 0, 0, 0.9, (0, 0, 0, 5, 5, 5), [0.0]), (1, 1, 0, 0.8, (50, 50, 50, 55, 55, 55), [0.0])]
    frame = proposals(spark, rows)
    assert cluster_boxes(frame, dim=1).count() == 2
    assert cluster_boxes(frame.limit(0), dim=1).count() == 0


def test_threshold_is_strict_and_relative_to_the_seed(spark):
    # IoU of neighbours is exactly 0.5; with the seed's neighbour only
    a, b = (0, 0, 0, 0, 0, 2), (0, 0, 0, 0, 1, 2)
    rows = [(1, 0, 0, 0.9, a, [0.0]), (1, 1, 0, 0.8, b, [0.0])]
    assert iou(a, b) == 0.5
    assert cluster_boxes(proposals(spark, rows), 0.5).count() == 2
    assert cluster_boxes(proposals(spark, rows), 0.49).count() == 1


@pytest.mark.parametrize("threshold", [0.5, 0.2])
@pytest.mark.parametrize("max_group", [10_000, 5])
def test_both_plans_match_brute_force(spark, threshold, max_group):
    rows = random_rows(2, 60, seed=7, copies=15)
    members = cluster_members(
        proposals(spark, rows), threshold, max_group=max_group, pool=8
    ).collect()
    got = {(m["case_id"], m["fold"], m["det_idx"]): (m["seed_fold"], m["seed_det_idx"]) for m in members}
    assert got == brute_force(rows, threshold)
    assert all(
        m["is_seed"] == ((m["fold"], m["det_idx"]) == (m["seed_fold"], m["seed_det_idx"])) for m in members
    )


def test_hot_case_next_to_small_ones(spark):
    """One case holds most rows, half of them copies of one box."""
    rows = random_rows(4, 10, seed=1) + [
        (99, 0, i, 0.5, (5, 5, 5, 15, 15, 15), [1.0, 1.0]) for i in range(100)
    ]
    rows += [(99, 1, i, 0.4 + i / 1000, (5 + i % 30, 5, 5, 15 + i % 30, 15, 15), [2.0, 2.0]) for i in range(100)]
    frame = proposals(spark, rows)
    plain = cluster_boxes(frame, 0.5, 2, max_group=10_000)
    split = cluster_boxes(frame, 0.5, 2, max_group=50, pool=16)

    def key(df):
        return sorted(
            (r["case_id"], r["seed_fold"], r["seed_det_idx"], r["n_members"], round(r["score"], 9),
             tuple(round(x, 4) for x in r["embedding"]), tuple(r["source_detectors"]))
            for r in df.collect()
        )

    assert key(plain) == key(split)


def test_source_mask_equals_source_sets(spark):
    frame = proposals(spark, random_rows(3, 40, seed=3))
    sets = {(r["case_id"], r["seed_det_idx"]): r["source_detectors"] for r in cluster_boxes(frame).collect()}
    mask = {
        (r["case_id"], r["seed_det_idx"]): r["source_detectors"]
        for r in cluster_boxes(frame, max_source=4).collect()
    }
    assert sets == mask


def test_nan_scores_rank_last(spark):
    b = (0, 0, 0, 5, 5, 5)
    rows = [(1, 0, 0, float("nan"), b, [0.0]), (1, 1, 0, 0.1, b, [0.0])]
    got = cluster_members(proposals(spark, rows)).where("is_seed").collect()
    assert [(g["fold"], g["score"]) for g in got] == [(1, 0.1)]


def test_order_and_threshold_domain(spark):
    frame = proposals(spark, random_rows(2, 30, seed=5))
    scores = [(r["case_id"], -r["score"]) for r in order_candidates(cluster_boxes(frame)).collect()]
    assert scores == sorted(scores)
    with pytest.raises(ValueError):
        cluster_boxes(frame, 1.0)


def test_bounded_plan_shuffles_cases_once(spark):
    """One exchange by case, one Python evaluation; Python gets boxes only."""
    frame = proposals(spark, random_rows(2, 10, seed=2))
    plan = cluster_members(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 1
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5])
def test_iou_join_blocked_equals_plain(spark, threshold):
    rows = random_rows(2, 40, seed=11)
    frame = proposals(spark, rows)
    left = frame.where("fold < 2").select("case_id", F.col("det_idx").alias("l"), F.col("box").alias("left_box"))
    right = frame.where("fold >= 2").select("case_id", F.col("det_idx").alias("r"), F.col("box").alias("right_box"))
    expected = {
        (a[0], a[2], b[2])
        for a in rows
        for b in rows
        if a[0] == b[0] and a[1] < 2 <= b[1] and iou(a[4], b[4]) > threshold
    }
    for limit in (10_000, 3):
        joined = iou_join(left, right, threshold, cell=7, max_group=limit).collect()
        assert len(joined) == len(expected)
        assert {(j["case_id"], j["l"], j["r"]) for j in joined} == expected


def test_only_hot_keys_are_repeated(spark):
    left = spark.range(400).selectExpr("id % 40 AS k", "id", "IF(id % 40 < 2, 16, 1) AS n")
    right = spark.range(40).selectExpr("id AS k", "id * 10 AS v", "IF(id < 2, 16, 1) AS n")
    joined = skew.salted_join(left, right, ["k"], ["id"], salts="n")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # the repeats are generated, so that Spark underestimates them
    assert "BroadcastHashJoin" not in plan
    got = sorted((r["k"], r["id"], r["v"]) for r in joined.collect())
    assert got == sorted((i % 40, i, i % 40 * 10) for i in range(400))


def test_large_and_small_cases_by_rounds(spark, monkeypatch):
    made = np.random.default_rng(3)
    rows = []
    for case, n in ((1, 90), (2, 7), (3, 30)):
        for i in range(n):
            lo = [int(x) for x in made.integers(0, 30, 3)]
            rows.append((case, 0, i, float(made.random()), (*lo, *(x + 12 for x in lo)), [0]))
    frame = spark.createDataFrame(
        rows, f"case_id long, fold int, det_idx long, score double, box {BOX.simpleString()}, source_detectors array<int>"
    )

    def owners(max_group):
        members = clustering.cluster_members(frame, 0.3, max_group=max_group)
        return sorted((r["case_id"], r["det_idx"], r["seed_det_idx"]) for r in members.collect())

    want = owners(2048)
    monkeypatch.setattr(clustering, "MAX_GROUP", 20)
    assert owners(1) == want


def test_vectors_joined_to_members_give_the_same_clusters(spark):
    """Named embeddings, one of them missing and one there twice, next to proposals that hold them."""
    rows = [(k % 3, k % 5, k, (k * 7 % 8) / 8, k % 4, k % 9) for k in range(90)]
    flat = spark.createDataFrame(rows, "case_id BIGINT, fold INT, det_idx BIGINT, score DOUBLE, at BIGINT, vec_id BIGINT")
    box = "named_struct('min_d0', at, 'min_d1', 0L, 'min_d2', 0L, 'max_d0', at + 5, 'max_d1', 5L, 'max_d2', 5L) AS box"
    named = flat.selectExpr("case_id", "fold", "det_idx", "score", box, "array(fold) AS source_detectors", "vec_id")
    known = [(v, [float(v), 1.0]) for v in (*range(8), 3)]
    vectors = spark.createDataFrame(known, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    want = cluster_boxes(named.join(vectors, "vec_id"), 0.5, 2, max_source=4)
    for limit in (2048, 1):
        got = cluster_boxes(named, 0.5, 2, max_group=limit, max_source=4, vectors=vectors)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
