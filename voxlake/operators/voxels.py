"""Voxel tables ``(case_id, d0, d1, d2, intensity, mask)``: statistics and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.functions.frames import resampled_size
from voxlake.schemas import AXES, PROFILE_POSITIONS, SLICE_PERCENTILES

# voxels along an axis whose outputs one task makes at once, and outputs of a batch
BRICK, BATCH_OUTPUTS = 32, 1 << 16


def mask_stats(voxels: DataFrame) -> DataFrame:
    """Per case: tight box, foreground count, rounded centroid, mask values.

    Voxels are first combined per (case, mask value), at most 256 rows per case; an
    empty mask shows as zero foreground with a NULL box.
    """
    partial = voxels.groupBy("case_id", "mask").agg(
        F.count("*").alias("n"),
        *[F.min(a).cast("bigint").alias(f"lo_{a}") for a in AXES],
        *[F.max(a).cast("bigint").alias(f"hi_{a}") for a in AXES],
        *[F.sum(F.col(a).cast("bigint")).alias(f"sum_{a}") for a in AXES],
    )
    inside = F.col("mask") > 0

    def over_mask(agg, name: str) -> Column:
        return agg(F.when(inside, F.col(name)))

    combined = partial.groupBy("case_id").agg(
        F.coalesce(over_mask(F.sum, "n"), F.lit(0)).alias("foreground"),
        *[over_mask(F.min, f"lo_{a}").alias(f"min_{a}") for a in AXES],
        *[over_mask(F.max, f"hi_{a}").alias(f"max_{a}") for a in AXES],
        *[over_mask(F.sum, f"sum_{a}").alias(f"_sum_{a}") for a in AXES],
        F.array_sort(F.collect_set("mask")).alias("mask_values"),
    )
    centroid = [
        F.when(
            F.col("foreground") > 0, F.rint(F.col(f"_sum_{a}") / F.col("foreground"))
        ).cast("bigint").alias(f"c_{a}")
        for a in AXES
    ]
    return combined.select(
        "case_id",
        "foreground",
        *[f"{side}_{a}" for side in ("min", "max") for a in AXES],
        *centroid,
        "mask_values",
    )


def empty_masks(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("foreground") == 0).select("case_id")


def binary_mask_check(stats: DataFrame, allowed: Sequence[int] = (0, 1)) -> DataFrame:
    """Per case: does the mask hold allowed values only."""
    return stats.select("case_id", subset_of(F.col("mask_values"), allowed).alias("binary"))


def subset_of(values: Column, allowed: Sequence[int]) -> Column:
    return F.forall(values, lambda v: v.isin(*allowed))


def volume_stats(voxels: DataFrame) -> DataFrame:
    """Per case: shape and intensity minimum, maximum, mean."""
    return voxels.groupBy("case_id").agg(
        *[(F.max(a).cast("bigint") + 1).alias(f"n_{a}") for a in AXES],
        F.min("intensity").alias("intensity_min"),
        F.max("intensity").alias("intensity_max"),
        F.avg("intensity").alias("intensity_mean"),
    )


def axis_profile(voxels: DataFrame) -> DataFrame:
    """Mean intensity per (case, axis, index)."""
    planes = F.array(
        *[F.struct(F.lit(i).alias("axis"), F.col(a).alias("index")) for i, a in enumerate(AXES)]
    )
    return (
        voxels.select("case_id", "intensity", F.explode(planes).alias("p"))
        .groupBy("case_id", F.col("p.axis").alias("axis"), F.col("p.index").alias("index"))
        .agg(F.avg("intensity").alias("mean_intensity"))
    )


def profile_samples(
    profile: DataFrame, positions: Sequence[float] = PROFILE_POSITIONS
) -> DataFrame:
    """Per (case, axis): length, extremes, and the profile at the given fractions.

    The collected array is one axis of one volume.
    """
    line = F.sort_array(F.collect_list(F.struct("index", "mean_intensity")))
    lines = profile.groupBy("case_id", "axis").agg(
        F.count("*").alias("n"),
        F.min("mean_intensity").alias("profile_min"),
        F.max("mean_intensity").alias("profile_max"),
        line.alias("_line"),
    )

    def sample(q: float) -> Column:
        at = F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
        return F.col("_line")[at.cast("int")]["mean_intensity"]

    return lines.select(
        "case_id",
        "axis",
        "n",
        "profile_min",
        "profile_max",
        *[sample(q).alias(f"p{round(q * 100):02d}") for q in positions],
    )


def slice_percentiles(
    voxels: DataFrame,
    stats: DataFrame,
    levels: Sequence[float] = SLICE_PERCENTILES,
    approximate: bool = False,
) -> DataFrame:
    """Per (case, axis): percentiles of the slice through the mask's centroid.

    The exact percentile keeps a count per distinct intensity (256 for bytes).

    The outer join leaves the voxels where they are: only its right side, a row per case, can be
    broadcast, whatever size Spark expects of the voxels.
    """
    centroids = stats.where(F.col("foreground") > 0).select("case_id", *[f"c_{a}" for a in AXES])
    through = [F.col(a) == F.col(f"c_{a}") for a in AXES]
    hit = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(through)]))
    wanted = F.array(*[F.lit(float(q)) for q in levels])
    agg = (
        F.percentile_approx("intensity", wanted, 10_000)
        if approximate
        else F.percentile("intensity", wanted)
    )
    return (
        voxels.join(centroids, "case_id", "left")
        .where(through[0] | through[1] | through[2])
        .select("case_id", "intensity", F.explode(hit).alias("axis"))
        .groupBy("case_id", "axis")
        .agg(agg.alias("_p"), F.count("*").alias("n"))
        .select(
            "case_id",
            "axis",
            "n",
            *[F.col("_p")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(levels)],
        )
    )


def tight_boxes(voxels: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Tight box per case with foreground; the mask filter reaches the scan.

    With ``keep_empty`` a case without foreground has a NULL box; all voxels are read then.
    """
    inside = F.col("mask") > 0

    def end(fn, axis: str):
        return fn(F.when(inside, F.col(axis))).cast("bigint")

    box = F.struct(
        *[end(F.min, a).alias(f"min_{a}") for a in AXES],
        *[end(F.max, a).alias(f"max_{a}") for a in AXES],
    )
    count = F.count_if(inside)
    rows = voxels if keep_empty else voxels.where(inside)
    return rows.groupBy("case_id").agg(
        F.when(count > 0, box).alias("box"), count.alias("foreground")
    )


# --- resampling -------------------------------------------------------------


def _axis_candidates(index: Column, size: Column, spacing: float, target: float) -> Column:
    """Output indices that may read a source index along one axis.

    The last source index also answers for the outputs beyond it.
    """
    step = F.lit(target / spacing)
    last = size - 1
    n_out = resampled_size(size, spacing, target)
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((index - 1) / step))
    high = F.least(
        n_out - 1, F.when(index == last, n_out - 1).otherwise(F.ceil((index + 1) / step))
    )
    none = F.array().cast("array<bigint>")
    return F.when(low <= high, F.sequence(low, high)).otherwise(none)


def _axis_weight(
    out: Column, index: Column, size: Column, spacing: float, target: float, mode: str
) -> Column:
    """Weight of a source index in an output index, NULL where it has none.

    An output at ``out * target / spacing`` reads its two neighbours (linear) or the
    closest index (nearest, halves up). Beyond half a voxel past the last index the
    output is 0, which the last source index states with weight 0.
    """
    last = size - 1
    at = out * F.lit(target / spacing)
    if mode == "nearest":
        weight = F.when(F.least(F.floor(at + 0.5), last) == index, F.lit(1.0))
    else:
        # distance to the clamped position; neighbours are closer than one voxel
        near = 1 - F.abs(F.least(at, last.cast("double")) - index)
        weight = F.when(near > 0, near)
    return F.when(at > last + F.lit(0.5), F.when(index == last, F.lit(0.0))).otherwise(weight)


def _axis_reads(size: int, brick: int, edge: int, spacing: float, target: float) -> tuple[np.ndarray, ...]:
    """Outputs of a brick along one axis: (index, its lower voxel in the brick, weights of this and the next voxel).

    The same rule as ``_axis_weight``; a next voxel that has no weight has NaN.
    """
    last = size - 1
    out = np.arange(max(1, int(np.rint(size * spacing / target))))
    at = out * (target / spacing)
    near = np.minimum(at, float(last))
    low = np.floor(near).astype(np.int64)
    beyond = at > last + 0.5
    lower, upper = 1 - np.abs(near - low), 1 - np.abs(near - (low + 1))
    lower, upper = np.where(beyond, 0.0, lower), np.where(beyond | (upper <= 0), np.nan, upper)
    here = low // edge == brick
    return out[here], low[here] - brick * edge, lower[here], upper[here]


def _along(axis: int, reads: tuple[np.ndarray, ...], total: np.ndarray, known: np.ndarray, present: np.ndarray):
    """The outputs of one axis: weighted sums of voxels, and whether any has a value, and is there at all."""
    _, low, lower, upper = reads
    shape = [-1 if i == axis else 1 for i in range(3)]
    high = np.minimum(low + 1, total.shape[axis] - 1)
    two = ~np.isnan(upper).reshape(shape)
    with np.errstate(invalid="ignore"):
        sums = total.take(low, axis) * lower.reshape(shape)
        sums += np.where(two, total.take(high, axis) * upper.reshape(shape), 0.0)
    any_of = [m.take(low, axis) | (two & m.take(high, axis)) for m in (known, present)]
    return sums, *any_of


def _brick_outputs(cell: np.ndarray, values: np.ndarray, sizes, bricks, edge: int, spacing, target) -> Iterator[tuple]:
    """(d0, d1, d2, sums, known) of the outputs of a brick, batch by batch; ``values`` are NaN with ``known`` false if NULL."""
    values, known_rows = values
    dims = [min(edge + 1, n - b * edge) for n, b in zip(sizes, bricks, strict=True)]
    at = np.ravel_multi_index(np.unravel_index(cell, (edge + 1,) * 3), dims)
    cells = prod(dims)
    present = (np.bincount(at, minlength=cells) > 0).reshape(dims)
    known = (np.bincount(at[known_rows], minlength=cells) > 0).reshape(dims)
    total = np.bincount(at[known_rows], values[known_rows], cells).reshape(dims)
    reads = [_axis_reads(n, b, edge, s, t) for n, b, s, t in zip(sizes, bricks, spacing, target, strict=True)]
    if not all(len(r[0]) for r in reads):
        return
    planes = max(1, BATCH_OUTPUTS // (len(reads[1][0]) * len(reads[2][0])))
    for k in range(0, len(reads[0][0]), planes):
        some = [tuple(x[k : k + planes] for x in reads[0]), *reads[1:]]
        grids = (total, known, present)
        for axis in range(3):
            grids = _along(axis, some[axis], *grids)
        sums, valued, there = grids
        where = np.nonzero(there)
        yield *[some[axis][0][where[axis]] for axis in range(3)], sums[where], valued[where]


def _resample_finer(
    voxels: DataFrame, counts: Sequence[str], spacing: Sequence[float], target: Sequence[float], value: str
) -> DataFrame:
    """Linear resampling to more outputs than there are voxels: voxels are shuffled, outputs are not.

    Voxels meet in bricks of ``BRICK`` a side and those next to them, and each output is made in the brick
    of its lower neighbours.
    """
    edge = BRICK
    names = [f"_b{i}" for i in range(3)]
    rows = voxels
    for axis, count, name in zip(AXES, counts, names, strict=True):
        index = F.col(axis).cast("bigint")
        # the first of a brick is the upper neighbour of outputs of the one before
        own = F.sequence(F.floor(F.greatest(index - 1, F.lit(0)) / edge), F.floor(index / edge))
        rows = rows.where(index.between(0, F.col(count) - 1)).withColumn(name, F.explode(own))
    cell = F.lit(0).cast("bigint")
    for axis, name in zip(AXES, names, strict=True):
        cell = cell * (edge + 1) + (F.col(axis) - F.col(name) * edge)
    voxel = F.struct(cell.cast("int").alias("cell"), F.col(value).cast("double").alias("value"))
    packed = rows.groupBy("case_id", *counts, *names).agg(F.collect_list(voxel).alias("_voxels"))
    schema = T.StructType(
        [
            voxels.schema["case_id"],
            *[T.StructField(a, T.LongType()) for a in AXES],
            T.StructField(value, T.DoubleType()),
        ]
    )

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            lists = batch.column("_voxels")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            cells, held = flat.field(0).to_numpy(), flat.field(1)
            known = held.is_valid().to_numpy(zero_copy_only=False)
            held = held.to_numpy(zero_copy_only=False)
            sizes = list(zip(*(batch.column(c).to_pylist() for c in counts), strict=True))
            bricks = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            for r in range(batch.num_rows):
                one = slice(ends[r], ends[r + 1])
                made = _brick_outputs(cells[one], (held[one], known[one]), sizes[r], bricks[r], edge, spacing, target)
                for *at, sums, valued in made:
                    case = pa.repeat(batch.column("case_id")[r], len(sums))
                    columns = [case, *map(pa.array, at), pa.array(sums, mask=~valued)]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return packed.mapInArrow(resample, schema)


def resample_volume(
    voxels: DataFrame,
    sizes: DataFrame,
    spacing: Sequence[float],
    target: Sequence[float],
    mode: str = "linear",
    value: str = "intensity",
) -> DataFrame:
    """Volume on the ``target`` grid with the same origin: (case_id, d0, d1, d2, value).

    Every source voxel is sent to the few outputs it contributes to, instead of every
    output fetching eight neighbours: there is no gather join, voxels that no output
    reads are dropped before the shuffle, and partial sums combine on the map side.
    ``nearest`` has one source per output and does not shuffle at all. Where outputs are more than
    the voxels, these are shuffled instead.

    ``sizes(case_id, n_d0, n_d1, n_d2)`` holds one row per case; a volume without one fails
    the job.
    """
    if mode not in ("linear", "nearest"):
        raise ValueError(f"mode must be 'linear' or 'nearest', got {mode!r}")
    counts = [f"n_{a}" for a in AXES]
    out = voxels.select("case_id", *AXES, value).join(
        sizes.select("case_id", *counts), "case_id", "left"
    )
    message = F.concat(F.lit("a volume has no size: case "), F.col("case_id").cast("string"))
    for name in counts:
        unknown = F.raise_error(message).cast(sizes.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(name, unknown))
    if mode == "linear" and prod(target) < prod(spacing):
        return _resample_finer(out, counts, spacing, target, value)
    # axis by axis, so that voxels no output reads are dropped as early as possible
    for i, axis in enumerate(AXES):
        index, size = F.col(axis).cast("bigint"), F.col(f"n_{axis}").cast("bigint")
        out = (
            out.withColumn(
                f"_i_{axis}", F.explode(_axis_candidates(index, size, spacing[i], target[i]))
            )
            .withColumn(
                f"_w_{axis}",
                _axis_weight(F.col(f"_i_{axis}"), index, size, spacing[i], target[i], mode),
            )
            .where(F.col(f"_w_{axis}").isNotNull())
        )
    weight = F.col(f"_w_{AXES[0]}") * F.col(f"_w_{AXES[1]}") * F.col(f"_w_{AXES[2]}")
    placed = out.select(
        "case_id",
        *[F.col(f"_i_{a}").alias(a) for a in AXES],
        (F.col(value) * weight).alias(value),
    )
    if mode == "nearest":
        return placed
    return placed.groupBy("case_id", *AXES).agg(F.sum(value).alias(value))
