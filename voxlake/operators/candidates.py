"""Detections to candidates: conversion, provenance, guards, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.errors import ProvenanceError
from voxlake.functions import frames
from voxlake.functions.vectors import divide_vector, l2_norm, require_dim, sum_vector, vector_agg
from voxlake.operators.ranking import descending_nan_last, first_rows, rank_within
from voxlake.schemas import EMBEDDING_DIM, N_FOLDS

PROPOSAL_ORDER = ("fold", "det_idx")


def proposal_order() -> list[Column]:
    """Score descending (NaN last), ties in input order: fold, then ordinal."""
    return [descending_nan_last(F.col("score")), *[F.col(c) for c in PROPOSAL_ORDER]]


def score_rank(proposals: DataFrame, max_group: int = 1_000_000) -> DataFrame:
    return rank_within(proposals, ["case_id"], proposal_order(), "rank", max_group)


def top_boxes(detections: DataFrame, n: int, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Best ``n`` boxes per group; NaN scores last, later ordinals first on ties."""
    safe = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    return first_rows(detections, list(keys), [safe.desc(), F.col("det_idx").desc()], n)


def cap_detections(detections: DataFrame, n: int = 100) -> DataFrame:
    """Operating point of the detector: at most ``n`` boxes per case and fold."""
    return top_boxes(detections, n, ("case_id", "fold"))


def retag(
    df: DataFrame, split: str | None = None, source: Column | int | None = None
) -> DataFrame:
    """Overwrite the provenance columns that are given."""
    if split is not None:
        df = df.withColumn("split", F.lit(split))
    if source is not None:
        ids = F.array(F.lit(source)) if isinstance(source, int) else source
        df = df.withColumn("source_detectors", ids.cast("array<int>"))
    return df


def detections_to_candidates(
    detections: DataFrame,
    split: str,
    source: Column,
    dim: int = EMBEDDING_DIM,
    slot_map: dict[str, tuple[int, int]] = frames.RESTORED_SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, degenerate rejects) of restored slot boxes.

    A NULL or wrongly sized embedding fails the job; a box that rounds to an upper
    bound below its lower bound goes to the rejects.
    """
    degenerate = frames.slots_degenerate(F.col("slots"), slot_map)
    rejects = detections.where(degenerate).select(
        "case_id", "det_idx", "slots", F.lit("degenerate box").alias("reason")
    )
    kept = detections.where(~degenerate).select(
        "case_id",
        F.lit(split).alias("split"),
        "det_idx",
        frames.slots_to_box(F.col("slots"), slot_map).alias("box"),
        F.col("score").cast("double").alias("score"),
        require_dim(F.col("embedding"), dim).cast("array<float>").alias("embedding"),
        source.cast("array<int>").alias("source_detectors"),
    )
    return kept, rejects


def _with_match(
    rows: DataFrame, others: DataFrame, on: list[str], known: str, what: str
) -> DataFrame:
    """Left join in which a row without a match fails the job; ``known`` is never NULL."""
    joined = rows.join(others, on, "left")
    message = F.concat(F.lit(f"a detection has no {what}: case "), F.col("case_id").cast("string"))
    kind = others.schema[known].dataType
    checked = F.when(F.col(known).isNull(), F.raise_error(message).cast(kind))
    return joined.withColumn(known, checked.otherwise(F.col(known)))


def tile_to_case(
    tile_detections: DataFrame, tiles: DataFrame,
    slot_map: dict[str, tuple[int, int]] = frames.TILE_SLOTS,
) -> DataFrame:
    """Tile-local slot boxes in case coordinates.

    Unlike restored boxes, degenerate ones are widened and kept. ``slot_map`` says
    which axis an origin entry belongs to. A detection whose tile is unknown fails the job.
    """
    joined = _with_match(tile_detections, tiles, ["case_id", "tile_idx"], "o_d0", "tile")
    shift = F.array("o_d0", "o_d1", "o_d2").cast("array<double>")
    return joined.withColumn(
        "box", frames.slots_to_box(F.col("slots"), slot_map, shift)
    ).withColumn("source_detectors", F.array(F.lit(0)))


def pack_detection_columns(candidates: DataFrame) -> DataFrame:
    """Candidate box back in the detector's slot order."""
    return candidates.withColumn("slots", frames.box_to_slots(F.col("box")))


def restore_frame(detections: DataFrame, case_props: DataFrame) -> DataFrame:
    """Slot boxes moved to the original grid with the per-case properties.

    A detection of a case without properties fails the job.
    """
    columns = detections.columns
    return (
        _with_match(detections, case_props, ["case_id"], "transpose_backward", "case properties")
        .withColumn(
            "slots",
            frames.restore_slots(
                F.col("slots"),
                F.col("transpose_backward"),
                F.col("original_spacing"),
                F.col("spacing_after_resampling"),
                F.col("crop_low"),
            ),
        )
        .select(*columns)
    )


def attach_fold(candidates: DataFrame, membership: DataFrame) -> DataFrame:
    """Candidates with the ``fold_of`` their case; NULL where the case is unknown."""
    return candidates.join(
        membership.select("case_id", F.col("fold").alias("fold_of")), "case_id", "left"
    )


def attach_by_ordinal(boxes: DataFrame, vectors: DataFrame) -> DataFrame:
    """1:1 pairing of boxes and embeddings by (case, fold, ordinal); no box is dropped."""
    return boxes.join(vectors, ["case_id", "fold", "det_idx"], "left")


def union_folds(*frames_: DataFrame) -> DataFrame:
    """Bag union of per-fold proposals."""
    first, *rest = frames_
    for df in rest:
        first = first.unionByName(df)
    return first


# --- guards -----------------------------------------------------------------


def leaked_cases(to_score: DataFrame, split: DataFrame, fold: int) -> DataFrame:
    """Cases to score that the fold's detector was trained on."""
    trained = split.where(F.col("fold") != fold).select("case_id")
    return to_score.select("case_id").distinct().join(trained, "case_id", "left_semi")


def out_of_scope(scored: DataFrame, allowed: DataFrame) -> DataFrame:
    """Scored cases outside the allowed set."""
    return scored.select("case_id").distinct().join(allowed, "case_id", "left_anti")


def _sample(df: DataFrame, n: int = 20) -> list[int]:
    """A few offending ids for an error message."""
    return [row[0] for row in df.orderBy("case_id").limit(n).collect()]


def leakage_guard(to_score: DataFrame, split: DataFrame, fold: int) -> None:
    """Raise, before anything is scored, if a case was in the fold's training data."""
    found = _sample(leaked_cases(to_score, split, fold))
    if found:
        raise ProvenanceError(f"fold {fold} was trained on cases to score, first ones: {found}")


def scored_within_scope(scored: DataFrame, allowed: DataFrame, fold: int) -> None:
    found = _sample(out_of_scope(scored, allowed))
    if found:
        raise ProvenanceError(f"scorer of fold {fold} returned cases out of scope: {found}")


def provenance_violations(
    candidates: DataFrame, membership: DataFrame, strict: bool = False, n_folds: int = N_FOLDS
) -> DataFrame:
    """Candidates with the provenance rule they break (NULL when none).

    Train candidates need exactly one source, equal to the fold of their case. Others
    need at least one source and none from ``n_folds`` up; ``strict`` also refuses
    negative ids and more than ``n_folds`` sources.
    """
    sources = F.col("source_detectors")
    n = F.size(sources)
    train_rule = (
        F.when(n != 1, "train: not exactly one source")
        .when(F.col("fold_of").isNull(), "train: case has no fold")
        .when(sources[0] != F.col("fold_of"), "train: source is not the case's fold")
    )
    other_rule = F.when(n == 0, "ensemble: no source").when(
        F.exists(sources, lambda s: s >= n_folds), "ensemble: source id too high"
    )
    if strict:
        other_rule = other_rule.when(
            F.exists(sources, lambda s: s < 0), "ensemble: negative source id"
        ).when(n > n_folds, "ensemble: too many sources")
    rule = F.when(F.col("split") == "train", train_rule).otherwise(other_rule)
    return attach_fold(candidates, membership).withColumn("rule", rule)


def provenance_report(
    candidates: DataFrame, membership: DataFrame, strict: bool = False
) -> DataFrame:
    """Per split: rows checked, and rows per broken rule (rule NULL: no violation)."""
    return (
        provenance_violations(candidates, membership, strict)
        .groupBy("split", "rule")
        .agg(F.count("*").alias("n"))
    )


def require_provenance(
    candidates: DataFrame, membership: DataFrame, strict: bool = False
) -> int:
    """Number of rows checked; raises on any violation."""
    rows = provenance_report(candidates, membership, strict).collect()
    bad = {(r["split"], r["rule"]): r["n"] for r in rows if r["rule"] is not None}
    if bad:
        raise ProvenanceError(f"provenance violations: {bad}")
    return sum(r["n"] for r in rows)


# --- summaries --------------------------------------------------------------


def candidate_summary(candidates: DataFrame, dim: int | None = None) -> DataFrame:
    """Per split: volumes, candidates, mean per volume, mean score, sources, embedding size.

    A known embedding width ``dim`` speeds the norms up.
    """
    n_vols = F.count_distinct("case_id")
    scalars = candidates.groupBy("split").agg(
        n_vols.alias("n_vols"),
        F.count("*").alias("n_candidates"),
        (F.count("*") / n_vols).alias("mean_per_vol"),
        F.avg("score").alias("mean_score"),
        F.max(F.size("embedding")).alias("emb_dim"),
        F.avg(l2_norm(F.col("embedding"), dim)).alias("mean_l2"),
    )
    sources = (
        candidates.select("split", F.explode("source_detectors").alias("s"))
        .groupBy("split")
        .agg(F.array_sort(F.collect_set("s")).alias("sources"))
    )
    return scalars.join(sources, "split", "left")


def embedding_variance(
    df: DataFrame, dim: int, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Population variance per embedding entry and group, as (keys..., dim, var, n)."""
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        vector_agg(F.col("embedding"), dim, F.var_pop).alias("_v"),
    )
    return grouped.select(*keys, "n", F.posexplode("_v").alias("dim", "var"))


def embedding_variance_gap(oof: DataFrame, ensemble: DataFrame, dim: int) -> DataFrame:
    """(dim, oof_var, ens_var, ratio); the ratio is infinite where ``ens_var`` is 0."""
    tagged = oof.select(F.lit("oof").alias("side"), "embedding").unionByName(
        ensemble.select(F.lit("ens").alias("side"), "embedding")
    )
    # one row per side, so the wide form is two rows before it is unpacked
    sides = tagged.groupBy("side").agg(
        vector_agg(F.col("embedding"), dim, F.var_pop).alias("v")
    )
    paired = sides.groupBy().agg(
        F.max(F.when(F.col("side") == "oof", F.col("v"))).alias("oof"),
        F.max(F.when(F.col("side") == "ens", F.col("v"))).alias("ens"),
    )
    message = F.lit("variance gap needs candidates on both sides")
    checked = paired.withColumn(
        "oof",
        F.when(F.col("oof").isNotNull() & F.col("ens").isNotNull(), F.col("oof")).otherwise(
            F.raise_error(message)
        ),
    )
    rows = checked.select(F.posexplode(F.arrays_zip("oof", "ens")).alias("dim", "e"))
    ratio = F.when(F.col("ens_var") > 0, F.col("oof_var") / F.col("ens_var")).otherwise(
        F.lit(float("inf"))
    )
    return rows.select(
        "dim", F.col("e.oof").alias("oof_var"), F.col("e.ens").alias("ens_var")
    ).withColumn("ratio", ratio)


def pooled_gap(gap: DataFrame) -> DataFrame:
    """Mean ratio over finite entries, NaN when there is none."""
    finite = ~F.isnan("ratio") & (F.abs("ratio") < F.lit(float("inf")))
    return gap.agg(
        F.coalesce(F.avg(F.when(finite, F.col("ratio"))), F.lit(float("nan"))).alias(
            "pooled_mean_ratio"
        ),
        F.count_if(finite).alias("n_finite"),
    )


def embedding_audit(detections: DataFrame, dim: int) -> DataFrame:
    """Per case: do shapes, norms, variance, first box and scores look alive.

    ``detections(case_id, det_idx, slots, score, embedding)``.

    The moments of a case are six times as wide as a vector, so rows are dealt by case as they
    are: sums made before that would be shuffled for nearly every row that joins have scattered.
    """
    norm = l2_norm(F.col("embedding"), dim)
    n = F.count("*")
    box = F.col("slots")
    # picking a flag instead of the box array keeps the aggregate on the hash path
    box_ok = F.col("_box_ok")
    right_size = F.size("embedding") == dim
    narrow = detections.select(
        "case_id",
        "det_idx",
        "score",
        "embedding",
        ((box[2] >= box[0]) & (box[3] >= box[1]) & (box[5] >= box[4])).alias("_box_ok"),
    )
    grouped = narrow.repartition("case_id").groupBy("case_id").agg(
        n.alias("n"),
        F.bool_and(right_size).alias("shape_ok"),
        (F.count("score") == n).alias("scores_ok"),
        F.min(norm).alias("norm_min"),
        F.max(norm).alias("norm_max"),
        F.avg(norm).alias("norm_mean"),
        F.min_by(box_ok, F.col("det_idx")).alias("box_ok"),
        # rows of another width have no variance here; shape_ok reports them
        vector_agg(F.when(right_size, F.col("embedding")), dim, F.var_pop).alias("_v"),
    )
    total = F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x)
    return grouped.select(
        "case_id",
        "n",
        "shape_ok",
        (F.col("norm_max") > 1e-6).alias("nonzero_ok"),
        ((F.col("n") == 1) | (F.array_max("_v") > 1e-12)).alias("varies_ok"),
        "box_ok",
        "scores_ok",
        "norm_min",
        "norm_max",
        "norm_mean",
        F.array_min("_v").alias("var_min"),
        F.array_max("_v").alias("var_max"),
        (total / dim).alias("var_mean"),
    ).withColumn(
        "all_ok",
        F.col("shape_ok")
        & F.col("nonzero_ok")
        & F.col("varies_ok")
        & F.col("box_ok")
        & F.col("scores_ok"),
    )
