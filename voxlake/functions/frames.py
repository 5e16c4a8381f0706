"""Coordinate-frame conversions.

Each frame is a column order plus an axis map and a convention for the upper
bound. Rounding is half-even throughout (``rint``).

=============== ============================== ===================== ============
frame           columns                        axis map              upper bound
=============== ============================== ===================== ============
storage         min_d0 .. max_d2               identity              inclusive
csv_center      c_x c_y c_z len_x len_y len_z  x=d2, y=d1, z=d0      len = max-min
yx_exclusive    y1 x1 y2 x2 z1 z2              y=d0, x=d1, z=d2      exclusive
xyz_tile        x1 y1 x2 y2 z1 z2              x=d2, y=d1, z=d0      copied as is
xyz_restored    x1 y1 x2 y2 z1 z2              x=d0, y=d1, z=d2      copied as is
=============== ============================== ===================== ============
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.functions.boxes import axis_centers, lower, make_box, per_axis, upper
from voxlake.schemas import AXES, ENDPOINT_ATOL, ORIGIN_MM, ROUNDTRIP_GATE_MM

# Fixed values: (lower slot, upper slot) of each storage axis in a six-slot detector box.
RESTORED_SLOTS = {"d0": (0, 2), "d1": (1, 3), "d2": (4, 5)}
TILE_SLOTS = {"d0": (4, 5), "d1": (1, 3), "d2": (0, 2)}


# --- center/size rows -------------------------------------------------------


def csv_endpoints(center: Sequence[Column], size: Sequence[Column]) -> tuple[list, list]:
    """Unrounded (minima, maxima) in the row's own x, y, z order."""
    half = [s / F.lit(2.0) for s in size]
    return (
        [c - h for c, h in zip(center, half, strict=True)],
        [c + h for c, h in zip(center, half, strict=True)],
    )


def csv_columns(prefix: str = "") -> tuple[list[Column], list[Column]]:
    return (
        [F.col(f"{prefix}c_{a}") for a in "xyz"],
        [F.col(f"{prefix}len_{a}") for a in "xyz"],
    )


def is_integer_endpoint(value: Column) -> Column:
    return F.abs(value - F.rint(value)) < F.lit(ENDPOINT_ATOL)


def integer_endpoint_check(center: Sequence[Column], size: Sequence[Column]) -> Column:
    """Name of the first endpoint that is not an integer voxel, NULL if all are."""
    minima, maxima = csv_endpoints(center, size)
    named = [
        (f"{side}_{axis}", values[i])
        for i, axis in enumerate("xyz")
        for side, values in (("min", minima), ("max", maxima))
    ]
    return F.coalesce(*[F.when(~is_integer_endpoint(v), F.lit(n)) for n, v in named])


def csv_to_box(center: Sequence[Column], size: Sequence[Column], check: bool = True) -> Column:
    """Storage box of a center/size row; a non-integer endpoint fails the task.

    Every endpoint guards itself, which keeps each bound a small expression of its
    own wherever the optimiser moves it.
    """

    def endpoint(value: Column, name: str) -> Column:
        if not check:
            return F.rint(value)
        message = F.concat(
            F.lit(f"endpoint {name} is not an integer voxel: "), value.cast("string")
        )
        return F.when(is_integer_endpoint(value), F.rint(value)).otherwise(F.raise_error(message))

    minima, maxima = csv_endpoints(center, size)
    lows = [endpoint(v, f"min_{a}") for v, a in zip(minima, "xyz", strict=True)]
    highs = [endpoint(v, f"max_{a}") for v, a in zip(maxima, "xyz", strict=True)]
    return make_box(lows[::-1], highs[::-1])


def box_to_csv(box: Column) -> Column:
    """Center/size struct; the size is ``max - min`` without the +1."""
    by_letter = dict(zip("xyz", reversed(AXES), strict=True))
    sizes = {c: (upper(box, a) - lower(box, a)).cast("double") for c, a in by_letter.items()}
    centers = {c: lower(box, a) + sizes[c] / F.lit(2.0) for c, a in by_letter.items()}
    return F.struct(
        *[centers[c].alias(f"c_{c}") for c in "xyz"],
        *[sizes[c].alias(f"len_{c}") for c in "xyz"],
    )


# --- exclusive yx frame -----------------------------------------------------


def box_to_yx_exclusive(box: Column) -> Column:
    letters = dict(zip(AXES, "yxz", strict=True))
    slots = {f"{letters[a]}1": lower(box, a) for a in AXES}
    slots |= {f"{letters[a]}2": upper(box, a) + 1 for a in AXES}
    return F.struct(*[slots[n].alias(n) for n in ("y1", "x1", "y2", "x2", "z1", "z2")])


def yx_exclusive_to_box(box: Column) -> Column:
    return make_box([box["y1"], box["x1"], box["z1"]], [box[n] - 1 for n in ("y2", "x2", "z2")])


# --- physical space ---------------------------------------------------------


def voxel_to_mm(point: Sequence[Column], spacing, origin=ORIGIN_MM) -> list[Column]:
    return [per_axis(origin, i) + p * per_axis(spacing, i) for i, p in enumerate(point)]


def mm_to_voxel(point: Sequence[Column], spacing, origin=ORIGIN_MM) -> list[Column]:
    return [(p - per_axis(origin, i)) / per_axis(spacing, i) for i, p in enumerate(point)]


def box_center_mm(box: Column, spacing, origin=ORIGIN_MM) -> list[Column]:
    return voxel_to_mm(axis_centers(box), spacing, origin)


def physical_extent(sizes: Sequence[Column], spacing) -> list[Column]:
    return [n * per_axis(spacing, i) for i, n in enumerate(sizes)]


def resampled_size(size: Column, spacing: Column | float, target: float) -> Column:
    """Voxels along one axis after resampling, at least one."""
    if target <= 0:
        raise ValueError(f"target spacing must be positive, got {target}")
    step = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return F.greatest(F.lit(1).cast("bigint"), F.rint(size * step / F.lit(target)).cast("bigint"))


# --- round trip through a resampled grid ------------------------------------


def box_grid_roundtrip(box: Column, target, original) -> Column:
    """Box after a trip to the ``target`` grid and back, rounded on both grids."""
    lows, highs = [], []
    for i, axis in enumerate(AXES):
        scale = per_axis(original, i) / per_axis(target, i)

        def there_and_back(edge: Column, scale: Column = scale) -> Column:
            return F.greatest(F.lit(0.0), F.rint(F.rint(edge * scale) / scale))

        low = there_and_back(lower(box, axis))
        high = F.greatest(there_and_back(upper(box, axis) + 1), low + 1)
        lows.append(low)
        highs.append(high - 1)
    return make_box(lows, highs)


def roundtrip_residuals(
    box: Column, recovered: Column, target, original, gate_mm: float = ROUNDTRIP_GATE_MM
) -> Column:
    """Residuals of ``recovered`` against ``box`` in voxels and mm, with both gates.

    ``recovered`` is normally ``box_grid_roundtrip(box, target, original)`` kept in
    a column of its own so that it is computed once.
    """
    low = [F.abs(lower(recovered, a) - lower(box, a)) for a in AXES]
    high = [F.abs(upper(recovered, a) - upper(box, a)) for a in AXES]
    spacing = [per_axis(original, i) for i in range(3)]
    envelope_mm = [(per_axis(target, i) + s) / F.lit(2.0) for i, s in enumerate(spacing)]
    envelope_vx = [
        F.ceil(e / s).cast("bigint") for e, s in zip(envelope_mm, spacing, strict=True)
    ]
    worst_mm = F.greatest(*[v * s for v, s in zip(low + high, spacing * 2, strict=True)])
    within = [F.greatest(low[i], high[i]) <= envelope_vx[i] for i in range(3)]
    primary, structural = worst_mm <= F.lit(gate_mm), within[0] & within[1] & within[2]
    failing = F.array_compact(
        F.array(*[F.when(~ok, F.lit(a)) for a, ok in zip(AXES, within, strict=True)])
    )
    return F.struct(
        F.array(*low, *high).alias("residuals_vx"),
        F.array(*[v * s for v, s in zip(low + high, spacing * 2, strict=True)]).alias(
            "residuals_mm"
        ),
        worst_mm.alias("max_residual_mm"),
        F.array(*envelope_mm).alias("envelope_mm"),
        F.array(*envelope_vx).alias("envelope_vx"),
        primary.alias("primary_pass"),
        structural.alias("structural_pass"),
        (primary & structural).alias("gate_pass"),
        failing.alias("failing_axes"),
    )


# --- detector slot boxes ----------------------------------------------------


def slots_to_box(slots: Column, slot_map: dict[str, tuple[int, int]], shift=None) -> Column:
    """Storage box from six float slots: half-even rounding, upper at least lower + 1.

    ``shift`` is an optional per-axis offset (array column in d0, d1, d2 order)
    added before rounding.
    """
    lows, highs = [], []
    for i, axis in enumerate(AXES):
        first, second = slot_map[axis]
        moved = [
            slots[s].cast("double") + (F.lit(0.0) if shift is None else shift[i])
            for s in (first, second)
        ]
        low, high = (F.rint(v).cast("bigint") for v in moved)
        lows.append(low)
        highs.append(F.greatest(high, low + 1))
    return make_box(lows, highs)


def slots_degenerate(slots: Column, slot_map: dict[str, tuple[int, int]]) -> Column:
    """True where the rounded upper bound lies below the lower one on any axis."""
    d0, d1, d2 = (
        F.rint(slots[b].cast("double")) < F.rint(slots[a].cast("double"))
        for a, b in (slot_map[x] for x in AXES)
    )
    return d0 | d1 | d2


def box_to_slots(box: Column, slot_map: dict[str, tuple[int, int]] = TILE_SLOTS) -> Column:
    """Detector slot order of a storage box (bounds copied as they are)."""
    slots: list[Column | None] = [None] * 6
    for axis, (first, second) in slot_map.items():
        slots[first], slots[second] = lower(box, axis), upper(box, axis)
    return F.array(*[s.cast("double") for s in slots])


def to_feature_coords(slots: Column, origin: Column, crop, fmap, slot_map=RESTORED_SLOTS) -> list:
    """Per axis (lower, upper) of a preprocessed box on a tile's feature grid."""
    pairs = []
    for i, axis in enumerate(AXES):
        stride = per_axis(crop, i) / per_axis(fmap, i)
        first, second = slot_map[axis]
        pairs.append(
            (
                (slots[first].cast("double") - origin[i]) / stride,
                (slots[second].cast("double") - origin[i]) / stride,
            )
        )
    return pairs


def grid_norm(coord: Column, size: int | Column, align_corners: bool = False) -> Column:
    """Pixel coordinate as a normalised [-1, 1] sampling coordinate."""
    n = size if isinstance(size, Column) else F.lit(int(size))
    if align_corners:
        return coord * 2.0 / F.greatest(n - 1, F.lit(1)) - 1.0
    return (coord * 2.0 + 1.0) / n - 1.0


def restore_slots(slots: Column, transpose_backward: Column, original: Column,
                  resampled: Column, crop_low: Column) -> Column:
    """Box slots moved from a case's preprocessed grid to its original grid.

    Permute the axes by ``transpose_backward``, rescale by
    ``resampled / original`` spacing (both in original axis order), then add the
    crop's lower corner. Slot order in and out: RESTORED_SLOTS.
    """
    lows = F.array(*[slots[RESTORED_SLOTS[a][0]].cast("double") for a in AXES])
    highs = F.array(*[slots[RESTORED_SLOTS[a][1]].cast("double") for a in AXES])
    out: list[Column | None] = [None] * 6
    for i, axis in enumerate(AXES):
        source = transpose_backward[i] + 1
        ratio = resampled[i] / original[i]
        for values, slot in zip((lows, highs), RESTORED_SLOTS[axis], strict=True):
            out[slot] = F.element_at(values, source) * ratio + crop_low[i]
    return F.array(*out)
