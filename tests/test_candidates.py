import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxlake.errors import ProvenanceError
from voxlake.operators import candidates as C
from voxlake.operators.ranking import rank_by_global_sort, rank_in_buckets, rank_within
from voxlake.plans import ensembles as E
from voxlake.plans import reports as P
from voxlake.schemas import BOX
from voxlake.sources import tables as T

SCHEMA = (
    f"case_id long, fold int, det_idx long, score double, box {BOX.simpleString()}, "
    "source_detectors array<int>, embedding array<float>, split string"
)
CUBE = (0, 0, 0, 5, 5, 5)


def candidates(spark, rows):
    """rows: (case, source list, split[, embedding])"""
    data = [
        (r[0], r[1][0] if r[1] else 0, i, 0.9, CUBE, r[1], r[3] if len(r) > 3 else [1.0, 1.0], r[2])
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def membership(spark):
    return spark.createDataFrame([(i, i) for i in range(5)], "case_id long, fold int")


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        ((2, [2], "train"), None),
        ((2, [1], "train"), "train: source is not the case's fold"),
        ((2, [2, 3], "train"), "train: not exactly one source"),
        ((77, [2], "train"), "train: case has no fold"),
        ((77, [0, 4], "val"), None),
        ((77, [], "val"), "ensemble: no source"),
        ((77, [0, 5], "test"), "ensemble: source id too high"),
        ((77, [-1], "val"), None),
    ],
)
def test_provenance_rules(spark, membership, row, rule):
    found = C.provenance_violations(candidates(spark, [row]), membership).first()
    assert found["rule"] == rule


def test_strict_provenance(spark, membership):
    frame = candidates(spark, [(7, [-1], "val"), (7, [0, 1, 2, 3, 4, 4], "val")])
    assert C.require_provenance(frame, membership) == 2
    with pytest.raises(ProvenanceError):
        C.require_provenance(frame, membership, strict=True)


def test_guard_fires_before_the_scorer(spark, membership):
    def never(_):
        raise AssertionError("scored a leaked case")

    leaked = membership.where("case_id = 3")
    with pytest.raises(ProvenanceError, match="3"):
        E.oof_candidates(1, never, membership, leaked)
    with pytest.raises(NotImplementedError):
        E.oof_candidates(1, None, membership)


def test_scorer_is_retagged_and_kept_in_scope(spark, membership):
    rows = candidates(spark, [(1, [4], "train")])
    out = E.oof_candidates(1, lambda _: rows, membership).first()
    assert out["source_detectors"] == [1]
    with pytest.raises(ProvenanceError, match="out of scope"):
        E.oof_candidates(2, lambda _: rows, membership)


def test_ensemble_tags_folds_and_refuses_train(spark):
    rows = candidates(spark, [(1, [0], "x")]).drop("fold")
    out = E.score_ensemble(lambda f: rows, range(3), "val", dim=2, max_source=4).collect()
    assert [(o["split"], o["source_detectors"], o["n_members"]) for o in out] == [("val", [0, 1, 2], 3)]
    with pytest.raises(ValueError):
        E.ensemble_proposals({0: rows}, "train")
    with pytest.raises(NotImplementedError):
        E.score_ensemble(None, range(3), "val")


def test_variance_gap(spark):
    oof = candidates(spark, [(1, [0], "train", [0.0, 0.0]), (1, [0], "train", [2.0, 2.0])])
    ens = candidates(spark, [(1, [0], "val", [0.0, 5.0]), (1, [0], "val", [4.0, 5.0])])
    gap = C.embedding_variance_gap(oof, ens, 2)
    ratios = [r["ratio"] for r in gap.orderBy("dim").collect()]
    assert ratios[0] == 0.25 and math.isinf(ratios[1])
    assert C.pooled_gap(gap).first()["pooled_mean_ratio"] == 0.25
    flat = C.pooled_gap(gap.where("dim = 1")).first()["pooled_mean_ratio"]
    assert math.isnan(flat)
    with pytest.raises(PySparkException, match="both sides"):
        C.embedding_variance_gap(oof, ens.limit(0), 2).collect()


def test_conversion_keeps_rejects_and_needs_embeddings(spark):
    rows = [
        (1, 0, [0.5, 1.5, 2.5, 3.5, 4.4, 5.6], 0.5, [1.0, 2.0]),
        (1, 1, [3.0, 1.0, 2.0, 3.0, 4.0, 5.0], 0.5, [1.0, 2.0]),
    ]
    schema = "case_id long, det_idx long, slots array<double>, score double, embedding array<float>"
    kept, rejects = C.detections_to_candidates(
        spark.createDataFrame(rows, schema), "train", F.array(F.lit(3)), 2
    )
    assert [tuple(r["box"]) for r in kept.collect()] == [(0, 2, 4, 2, 4, 6)]
    assert [r["det_idx"] for r in rejects.collect()] == [1]
    for bad in (None, [1.0]):
        broken = spark.createDataFrame([(*rows[0][:4], bad)], schema)
        with pytest.raises(PySparkException, match="embedding must have"):
            C.detections_to_candidates(broken, "train", F.array(F.lit(3)), 2)[0].collect()


def test_top_boxes(spark):
    scores = [0.1, float("nan"), 0.9, 0.9, 0.5]
    frame = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "case_id long, det_idx long, score double")

    def top(n):
        return [r["det_idx"] for r in C.top_boxes(frame, n).orderBy("rank").collect()]

    assert top(3) == [3, 2, 4]
    assert top(99) == [3, 2, 4, 0, 1]
    assert top(0) == []


def test_ranks_agree_for_hot_groups(spark):
    frame = spark.range(3000).selectExpr(
        "IF(id % 3 < 2, 0, id % 7) AS case_id", "id % 50 AS v", "id AS det_idx"
    )
    order = [F.col("v").desc(), F.col("det_idx")]
    plain = rank_within(frame, ["case_id"], order)
    hot = rank_within(frame, ["case_id"], order, max_group=500)
    sorted_ = rank_by_global_sort(frame, ["case_id"], order)
    bucketed = rank_in_buckets(frame, ["case_id"], order, -F.col("v"))
    for other in (hot, sorted_, bucketed):
        cols = ["case_id", "det_idx", F.col("rank").cast("bigint")]
        assert plain.select(*cols).exceptAll(other.select(*cols)).isEmpty()
        assert other.count() == 3000


def test_candidate_store_round_trip(spark, tmp_path):
    frame = candidates(spark, [(1, [1], "train"), (2, [0, 3], "val"), (3, [], "val")])
    T.write_candidates(frame, str(tmp_path / "c"))
    back = T.read_candidates(spark, str(tmp_path / "c"))
    assert back.select(*frame.columns).exceptAll(frame).isEmpty() and back.count() == 3
    val = T.read_candidates(spark, str(tmp_path / "c"), "val")
    assert sorted(r["source_detectors"] for r in val.collect()) == [[], [0, 3]]
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_candidate_report_and_audit(spark, membership):
    frame = candidates(spark, [(1, [1], "train", [0.0, 3.0]), (2, [2], "train", [4.0, 0.0]), (9, [0, 1], "val")])
    report = P.candidate_report(frame, membership, 2)
    summary = {r["split"]: r for r in report["summary"].collect()}
    assert summary["train"]["n_vols"] == 2 and summary["train"]["mean_l2"] == 3.5
    assert summary["val"]["sources"] == [0, 1] and report["gap"].count() == 2
    audited = frame.withColumn("slots", F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0, 0.0, 1.0)]))
    rows = C.embedding_audit(audited, 2).collect()
    assert all(r["all_ok"] for r in rows)
    zero = C.embedding_audit(audited.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0))), 2)
    assert not zero.where("nonzero_ok").count()


def test_embedding_audit_deals_rows_not_moments(spark):
    rows = [(i % 3, i, [0.0, 0.0, 1.0, 1.0, 0.0, 1.0], 0.5, [float(i), 1.0]) for i in range(30)]
    schema = "case_id long, det_idx long, slots array<double>, score double, embedding array<float>"
    audit = C.embedding_audit(spark.createDataFrame(rows, schema).repartition(8), 2)
    plan = audit._jdf.queryExecution().executedPlan().toString()
    # no partial aggregate below the exchange by case
    assert "HashAggregate" not in plan[plan.index("Exchange hashpartitioning(case_id"):]
    got = {r["case_id"]: r for r in audit.collect()}
    assert all(r["n"] == 10 and r["all_ok"] for r in got.values())
    assert got[0]["var_max"] == pytest.approx(sum((3 * k - 13.5) ** 2 for k in range(10)) / 10)
