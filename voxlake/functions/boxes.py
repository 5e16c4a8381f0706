"""Box algebra as native columns (storage frame, inclusive upper bounds).

A box is a struct column of six bigints (``schemas.BOX``). Everything here is
built from arithmetic, ``least`` and ``greatest``, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.schemas import AXES, BOX_FIELDS


def lower(box: Column, axis: str) -> Column:
    return box[f"min_{axis}"]


def upper(box: Column, axis: str) -> Column:
    return box[f"max_{axis}"]


def per_axis(values: Sequence[float] | Column, i: int) -> Column:
    """The i-th entry of a per-axis parameter given as a tuple or array column."""
    return values[i] if isinstance(values, Column) else F.lit(float(values[i]))


def product(factors: Sequence[Column]) -> Column:
    first, second, third = factors
    return first * second * third


def make_box(lows: Sequence[Column], highs: Sequence[Column]) -> Column:
    parts = [*lows, *highs]
    return F.struct(
        *[p.cast("bigint").alias(n) for n, p in zip(BOX_FIELDS, parts, strict=True)]
    )


def box_from_columns(prefix: str = "") -> Column:
    """Struct box from the six flat columns ``<prefix>min_d0`` ... ``<prefix>max_d2``."""
    return F.struct(*[F.col(prefix + n).cast("bigint").alias(n) for n in BOX_FIELDS])


def flatten_box(box: Column, prefix: str = "") -> list[Column]:
    return [box[n].alias(prefix + n) for n in BOX_FIELDS]


def box_valid(box: Column) -> Column:
    d0, d1, d2 = (lower(box, a) <= upper(box, a) for a in AXES)
    return d0 & d1 & d2


def assert_box(box: Column) -> Column:
    """The box itself; the task fails on a box whose lower bound exceeds its upper."""
    message = F.concat(F.lit("box has min > max: "), F.to_json(box))
    return F.when(box_valid(box), box).otherwise(F.raise_error(message))


def box_to_array(box: Column) -> Column:
    return F.array(*[box[n] for n in BOX_FIELDS])


def array_to_box(values: Column) -> Column:
    return F.struct(*[values[i].cast("bigint").alias(n) for i, n in enumerate(BOX_FIELDS)])


def axis_extents(box: Column) -> list[Column]:
    return [upper(box, a) - lower(box, a) + F.lit(1) for a in AXES]


def box_extent(box: Column) -> Column:
    return F.array(*axis_extents(box))


def box_volume(box: Column) -> Column:
    return product(axis_extents(box))


def axis_centers(box: Column) -> list[Column]:
    return [(lower(box, a) + upper(box, a)) / F.lit(2.0) for a in AXES]


def box_center(box: Column) -> Column:
    return F.array(*axis_centers(box))


def intersection_volume(a: Column, b: Column) -> Column:
    overlaps = [
        F.greatest(
            F.lit(0).cast("bigint"),
            F.least(upper(a, x), upper(b, x)) - F.greatest(lower(a, x), lower(b, x)) + F.lit(1),
        )
        for x in AXES
    ]
    return product(overlaps)


def iou_3d(a: Column, b: Column) -> Column:
    """Intersection over union of inclusive boxes; 0.0 where they are disjoint."""
    inter = intersection_volume(a, b)
    union = box_volume(a) + box_volume(b) - inter
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / union)


def shape_stats(box: Column, spacing: Sequence[float] | Column) -> Column:
    """Struct of physical volume, elongation (longest/shortest) and anisotropy
    (longest/middle); a ratio is infinite where its divisor is not positive."""
    edges = [e * per_axis(spacing, i) for i, e in enumerate(axis_extents(box))]
    shortest, longest = F.least(*edges), F.greatest(*edges)
    middle = F.sort_array(F.array(*edges))[1]
    infinite = F.lit(float("inf"))
    return F.struct(
        (shortest * middle * longest).alias("volume_mm3"),
        F.when(shortest > 0, longest / shortest).otherwise(infinite).alias("elongation"),
        F.when(middle > 0, longest / middle).otherwise(infinite).alias("anisotropy"),
    )


def box_clip(box: Column, shape: Sequence[int] | Column, on_invalid: str = "raise") -> Column:
    """Clamp a box into ``[0, shape - 1]``.

    A box wholly outside has no valid clip: ``on_invalid`` says whether the task
    fails (``raise``) or the result is NULL (``null``).
    """
    if on_invalid not in ("raise", "null"):
        raise ValueError(f"on_invalid must be 'raise' or 'null', got {on_invalid!r}")
    sizes = [shape[i] if isinstance(shape, Column) else F.lit(int(shape[i])) for i in range(3)]
    clipped = make_box(
        [F.greatest(F.lit(0).cast("bigint"), lower(box, a)) for a in AXES],
        [F.least(n.cast("bigint") - 1, upper(box, a)) for a, n in zip(AXES, sizes, strict=True)],
    )
    if on_invalid == "raise":
        return assert_box(clipped)
    return F.when(box_valid(clipped), clipped)


def box_contains(box: Column, point: Sequence[Column]) -> Column:
    d0, d1, d2 = (
        p.between(lower(box, a), upper(box, a)) for a, p in zip(AXES, point, strict=True)
    )
    return d0 & d1 & d2
